"""Hong Kong place names and the districts they stand for."""

from wayfare.operators.gazetteer import alias_list

# Names and districts. The order of the names decides the order of the districts.
_KOWLOON = ["九龍城區", "黃大仙區", "深水埗區", "觀塘區", "油尖旺區"]
_NEW_TERRITORIES = [
    "荃灣區", "葵青區", "屯門區", "元朗區", "北區", "大埔區", "沙田區", "西貢區", "離島區",
]
_ISLAND = ["中西區", "灣仔區", "東區", "南區"]

ENGLISH = {
    "kowloon": _KOWLOON,
    "new territories": _NEW_TERRITORIES,
    "nt": _NEW_TERRITORIES,
    "hong kong island": _ISLAND,
    "hk island": _ISLAND,
    "central": ["中西區"],
    "central and western": ["中西區"],
    "sheung wan": ["中西區"],
    "soho": ["中西區"],
    "mid levels": ["中西區"],
    "wan chai": ["灣仔區"],
    "causeway bay": ["灣仔區"],
    "tin hau": ["灣仔區"],
    "happy valley": ["灣仔區"],
    "north point": ["東區"],
    "quarry bay": ["東區"],
    "taikoo": ["東區"],
    "shau kei wan": ["東區"],
    "chai wan": ["東區"],
    "eastern": ["東區"],
    "southern": ["南區"],
    "aberdeen": ["南區"],
    "ap lei chau": ["南區"],
    "stanley": ["南區"],
    "pok fu lam": ["南區"],
    "kowloon city": ["九龍城區"],
    "to kwa wan": ["九龍城區"],
    "hung hom": ["九龍城區"],
    "ho man tin": ["九龍城區"],
    "sham shui po": ["深水埗區"],
    "cheung sha wan": ["深水埗區"],
    "lai chi kok": ["深水埗區"],
    "mei foo": ["深水埗區"],
    "yau tsim mong": ["油尖旺區"],
    "mong kok": ["油尖旺區"],
    "yau ma tei": ["油尖旺區"],
    "tsim sha tsui": ["油尖旺區"],
    "jordan": ["油尖旺區"],
    "prince edward": ["油尖旺區"],
    "kwun tong": ["觀塘區"],
    "ngau tau kok": ["觀塘區"],
    "kowloon bay": ["觀塘區"],
    "lam tin": ["觀塘區"],
    "yau tong": ["觀塘區"],
    "wong tai sin": ["黃大仙區"],
    "diamond hill": ["黃大仙區"],
    "chuk yuen": ["黃大仙區"],
    "tsz wan shan": ["黃大仙區"],
    "tsuen wan": ["荃灣區"],
    "kwai tsing": ["葵青區"],
    "kwai chung": ["葵青區"],
    "tsing yi": ["葵青區"],
    "tuen mun": ["屯門區"],
    "yuen long": ["元朗區"],
    "tin shui wai": ["元朗區"],
    "north district": ["北區"],
    "sheung shui": ["北區"],
    "fanling": ["北區"],
    "tai po": ["大埔區"],
    "sha tin": ["沙田區"],
    "shatin": ["沙田區"],
    "ma on shan": ["沙田區"],
    "sai kung": ["西貢區"],
    "tseung kwan o": ["西貢區"],
    "islands": ["離島區"],
    "lantau": ["離島區"],
    "lantau island": ["離島區"],
    "discovery bay": ["離島區"],
    "mui wo": ["離島區"],
    "cheung chau": ["離島區"],
}

CHINESE = {
    "九龍": _KOWLOON,
    "新界": _NEW_TERRITORIES,
    "港島": _ISLAND,
    "中西區": ["中西區"],
    "中環": ["中西區"],
    "上環": ["中西區"],
    "蘇豪": ["中西區"],
    "半山": ["中西區"],
    "灣仔": ["灣仔區"],
    "銅鑼灣": ["灣仔區"],
    "天后": ["灣仔區"],
    "跑馬地": ["灣仔區"],
    "東區": ["東區"],
    "北角": ["東區"],
    "鰂魚涌": ["東區"],
    "太古": ["東區"],
    "筲箕灣": ["東區"],
    "柴灣": ["東區"],
    "南區": ["南區"],
    "香港仔": ["南區"],
    "鴨脷洲": ["南區"],
    "赤柱": ["南區"],
    "薄扶林": ["南區"],
    "九龍城": ["九龍城區"],
    "土瓜灣": ["九龍城區"],
    "紅磡": ["九龍城區"],
    "何文田": ["九龍城區"],
    "深水埗": ["深水埗區"],
    "長沙灣": ["深水埗區"],
    "荔枝角": ["深水埗區"],
    "美孚": ["深水埗區"],
    "油尖旺": ["油尖旺區"],
    "旺角": ["油尖旺區"],
    "油麻地": ["油尖旺區"],
    "尖沙咀": ["油尖旺區"],
    "佐敦": ["油尖旺區"],
    "太子": ["油尖旺區"],
    "觀塘": ["觀塘區"],
    "牛頭角": ["觀塘區"],
    "九龍灣": ["觀塘區"],
    "藍田": ["觀塘區"],
    "油塘": ["觀塘區"],
    "黃大仙": ["黃大仙區"],
    "鑽石山": ["黃大仙區"],
    "竹園": ["黃大仙區"],
    "慈雲山": ["黃大仙區"],
    "荃灣": ["荃灣區"],
    "葵青": ["葵青區"],
    "葵涌": ["葵青區"],
    "青衣": ["葵青區"],
    "屯門": ["屯門區"],
    "元朗": ["元朗區"],
    "天水圍": ["元朗區"],
    "北區": ["北區"],
    "上水": ["北區"],
    "粉嶺": ["北區"],
    "大埔": ["大埔區"],
    "沙田": ["沙田區"],
    "馬鞍山": ["沙田區"],
    "西貢": ["西貢區"],
    "將軍澳": ["西貢區"],
    "離島": ["離島區"],
    "大嶼山": ["離島區"],
    "愉景灣": ["離島區"],
    "梅窩": ["離島區"],
    "長洲": ["離島區"],
}

HONG_KONG = alias_list(ENGLISH, CHINESE)
