"""DuckDB SQL with the result each registered query must give."""

from __future__ import annotations

from checks.inputs import ANSWERS_SQL, CAPTIONS_SQL, RECORDS_SQL, VENUES_SQL
from wayfare.functions.places_hk import HONG_KONG

WORD = r"[\p{L}\p{N}_]+"
ROUND = 6


def _strip(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def _key(c: str) -> str:
    return f"lower({_strip(c)})"


def _lenient(c: str) -> str:
    bare = f"replace(replace({c}, 'HKD', ''), '$', '')"
    return rf"try_cast(nullif(regexp_extract({bare}, '(\d+(\.\d+)?)', 1), '') as double)"


def _strict(c: str) -> str:
    bare = _strip(f"replace(replace({c}, 'HKD', ''), '$', '')")
    return (
        f"case when contains({c}, 'HKD') and not contains({c}, '-') "
        rf"and regexp_full_match({bare}, '[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?') "
        f"then try_cast({bare} as double) end"
    )


def _coordinate(i: int) -> str:
    raw = _strip("coordinates")
    parts = f"string_split(trim({raw}, '()'), ',')"

    def number(j: int) -> str:
        part = _strip(f"{parts}[{j}]")
        return rf"case when regexp_full_match({part}, '[+-]?\d+(\.\d*)?') then try_cast({part} as double) end"

    return (
        f"case when contains({raw}, '(') and contains({raw}, ')') and len({parts}) = 2 "
        f"and {number(1)} is not null and {number(2)} is not null then {number(i)} end"
    )


_DIGEST = (
    "sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || "
    f"encode({_key('name')} || '|' || {_key('district')}))"
)
_ID = (
    "(select x[1:8] || '-' || x[9:12] || '-5' || x[14:16] || '-' || "
    "substr('89ab', ((instr('0123456789abcdef', x[17]) - 1) % 4 + 1)::int, 1) || x[18:20] || '-' || "
    f"x[21:32] from (select {_DIGEST} as x))"
)

_TEXT = "trim(concat_ws(' ', coalesce(name, ''), coalesce(cuisine, ''), coalesce(address, ''), coalesce(description_highlights, '')))"

_RECORD_FIELDS = [
    '"Name"',
    '"Location"',
    '"Description/Highlights"',
    '"Why Recommended"',
    '"Cost Estimate"',
    '"Unique Tips"',
]


def _tokens(c: str) -> str:
    return f"regexp_extract_all(lower({c}), '{WORD}')"


def _count(c: str) -> str:
    return f"len({_tokens(f'coalesce({c}, {chr(39) * 2})')})"


_BOUNDS = [
    ("Description/Highlights", 5, 100),
    ("Why Recommended", 3, 50),
    ("Unique Tips", 2, 30),
    ("Cost Estimate", 1, 50),
]


def _reason(field: str, low: int, high: int) -> str:
    n = _count(f'"{field}"')
    return (
        f"case when {n} < {low} then '{field} too short: ' || {n} || ' tokens (min {low})' "
        f"when {n} > {high} then '{field} too long: ' || {n} || ' tokens (max {high})' end"
    )


_REASONS = f"concat_ws('; ', {', '.join(_reason(*b) for b in _BOUNDS)})"

# TF-IDF. ``_counts`` gives (doc_id, term, tf) of a relation (doc_id, text).


def _word_counts(rel: str) -> str:
    return (
        f"(select doc_id, term, count(*) as tf from (select doc_id, unnest({_tokens('text')}) "
        f"as term from {rel}) group by doc_id, term)"
    )


def _gram_counts(rel: str) -> str:
    return rf"""(select doc_id, term, sum(n)::bigint as tf from (
      select doc_id, substr(p, i::int, size::int) as term, n from (
        select doc_id, p, n, size, unnest(range(1, length(p) - size + 2)) as i from (
          select doc_id, p, n, unnest(range(2, least(4, length(p)) + 1)) as size from (
            select doc_id, ' ' || w || ' ' as p, count(*) as n from (
              select doc_id, unnest(regexp_split_to_array(lower(text), '\s+')) as w from {rel})
            where w <> '' group by all))))
      group by doc_id, term)"""


def _model(counts: str, n_docs: str, size: int, min_df: int = 2) -> str:
    """CTEs counts, vocab, weights."""
    return f"""counts as materialized (select * from {counts}),
    vocab as materialized (
      select *, row_number() over (order by term) - 1 as term_id from (
        select term, count(*) as df, sum(tf)::bigint as cf,
               ln((1 + ({n_docs}))::double / (count(*) + 1)) + 1 as idf
        from counts group by term having count(*) >= {min_df} order by cf desc, term limit {size})),
    weights as materialized ({_weights('counts')})"""


def _weights(counts: str) -> str:
    return f"""select doc_id, term_id, w / sqrt(sum(w * w) over (partition by doc_id)) as weight from (
      select doc_id, term_id, (1 + ln(tf)) * idf as w from {counts} join vocab using (term))"""


_N_DOCS = "select count(*) from documents"
_ASKED = "(select item_id as doc_id, text from benchmark)"
_TAGS = "(case item_id % 3 when 0 then [] when 1 then ['en'] else ['fr', 'de'] end)::varchar[]"
_WORD_MODEL = _model(_word_counts("documents"), _N_DOCS, 10_000)
_ASKED_WEIGHTS = f"asked as materialized ({_weights(_word_counts(_ASKED))})"
_PASSES = "(len(tags) = 0 or list_contains(tags, tag))"


def _ranked(scores: str, k: int) -> str:
    return f"""select query_id, rank, doc_id, score from (select *, row_number() over (
      partition by query_id order by score desc, doc_id) as rank from {scores}) where rank <= {k}"""


def _sparse(k: int, tagged: bool = False) -> str:
    joins = (
        f"join (select doc_id, lang as tag from documents) d on d.doc_id = w.doc_id "
        f"join (select item_id, {_TAGS} as tags from benchmark) b on b.item_id = q.doc_id"
        if tagged
        else ""
    )
    return _ranked(
        f"""(select q.doc_id as query_id, w.doc_id, round(sum(q.weight * w.weight), 6) as score
        from asked q join weights w using (term_id) {joins} {'where ' + _PASSES if tagged else ''}
        group by all)""",
        k,
    )


_COS = "round(list_cosine_similarity({a}::double[], {b}::double[]), 6)"


def _dense(k: int, tagged: bool = False, vectors: str = "embeddings") -> str:
    tags = "left join (select doc_id, lang as tag from documents) t on t.doc_id = d.vec_id"
    return _ranked(
        f"""(select item_id as query_id, d.vec_id as doc_id,
        {_COS.format(a='d.embedding', b='q.embedding')} as score
        from (select b.*, e.embedding, {_TAGS} as tags from benchmark b
              join embeddings e on e.vec_id = b.item_id) q
        cross join {vectors} d {tags if tagged else ''}
        {'where len(tags) = 0 or coalesce(list_contains(tags, tag), false)' if tagged else ''})""",
        k,
    )


_EMBEDDED = "(select * from embeddings where vec_id in (select doc_id from documents))"


def _candidates(k: int, tagged: bool = False) -> str:
    return f"""with {_WORD_MODEL}, {_ASKED_WEIGHTS}, candidates as materialized (
      select 'sparse' as list, * from ({_sparse(k, tagged)})
      union all select 'dense' as list, * from ({_dense(k, tagged)}))"""


_RRF = """(select query_id, doc_id, round(sum(1.0 / (60 + rank)), 6) as score
  from candidates group by all)"""
_DBSF = """(select query_id, doc_id, round(sum(coalesce(
    (score - (mean - 3 * deviation)) / (6 * nullif(deviation, 0)), 0.5)), 6) as score from (
    select *, avg(score) over l as mean, stddev_samp(score) over l as deviation
    from candidates window l as (partition by query_id, list)) group by query_id, doc_id)"""
_SPARSE_FUSED = f"""with {_WORD_MODEL}, {_ASKED_WEIGHTS},
  candidates as (select 'sparse' as list, * from ({_sparse(9, True)}))"""

# Near-duplicates: pairs, then a walk over the ids in order with the list of leaders so far.


def _pairs(rel: str, threshold: float) -> str:
    cos = _COS.format(a="x.embedding", b="y.embedding")
    return f"""pairs as materialized (select a, b, score from (
      select x.id as a, y.id as b, {cos} as score from {rel} x join {rel} y on x.id < y.id)
      where score >= {threshold})"""


_GROUPS = """smaller as materialized (select b as id, list(a) as before from pairs group by b),
    nodes as materialized (
      select n.id, before, row_number() over (order by n.id) as i from (
        select a as id from pairs union select b from pairs) n left join smaller using (id)),
    walk as (
      select 0::bigint as i, []::bigint[] as leaders
      union all
      select n.i, case when list_has_any(w.leaders, coalesce(n.before, []::bigint[]))
                       then w.leaders else list_append(w.leaders, n.id) end
      from walk w join nodes n on n.i = w.i + 1),
    leads as materialized (
      select unnest(leaders) as leader from (select leaders from walk order by i desc limit 1)),
    members as materialized (
      select a as leader, b as id from pairs join leads on leads.leader = pairs.a),
    grouped as materialized (
      select leader, id from members union select leader, leader as id from members)"""

_EMB = "(select vec_id as id, embedding from embeddings)"
_NEAR = f"with recursive {_pairs(_EMB, 0.377)}, {_GROUPS}"
_BEST = f"""best as materialized (select leader, id as keep from (
    select leader, g.id, row_number() over (partition by leader order by coalesce(n, 0) desc, g.id) as r
    from grouped g left join (select doc_id as id, {_count('text')} as n from documents) s
    on s.id = g.id) where r = 1)"""
_COPIES = """(select vec_id as id, embedding::float[] as embedding from embeddings union all
  select vec_id + 1000000, list_prepend((embedding[1] + 0.5::float)::float, embedding[2:])::float[]
  from embeddings)"""


def _buckets(rel: str) -> str:
    h = "0::bigint"
    for i in range(1, 5):
        step = f"(({h}) * 1000003 + unicode(substr(term, {i}, 1))) % 2147483647"
        h = f"case when length(term) >= {i} then {step} else {h} end" if i > 2 else step
    return f"""(select doc_id, ({h}) % 256 as bucket, sum(tf)::bigint as n
      from {_gram_counts(rel)} group by all)"""


def _hashed(rel: str) -> str:
    return f"""(select doc_id, list(coalesce(n, 0) / size order by bucket)::float[] as embedding from (
      select d.doc_id, s.bucket, n, sqrt(sum(n * n) over (partition by d.doc_id)) as size
      from (select distinct doc_id from {rel}) d cross join (select unnest(range(256)) as bucket) s
      left join {rel} h on h.doc_id = d.doc_id and h.bucket = s.bucket) group by doc_id)"""


_ALIASES = [
    ("the", "D1,D2,D3", True),
    ("of the", "D4", True),
    ("that", "D2,D5", True),
    ("in", "D6", True),
    ("on the", "D7,D1", True),
    ("was", "D8", True),
    ("tion", "D9,D2", False),
    ("The", "D10", False),
]
_HONG_KONG = [(a.text, ",".join(a.targets), a.whole_word) for a in HONG_KONG]
_BRANDS = [
    ("red", "Brand#1,Brand#2,Brand#3", True),
    ("small", "Brand#4,Brand#5", True),
    ("blue", "Brand#6", True),
    ("bolt", "Brand#7,Brand#8,Brand#9,Brand#2", True),
]
# Word borders on both sides of letters of any script: RE2's own \b knows ASCII only.
_BORDER = r"(^|[^\p{L}\p{N}\p{M}_])"
_BORDER_END = r"($|[^\p{L}\p{N}\p{M}_])"


def _alias_hits(rel: str, aliases) -> str:
    parts = []
    for i, (alias, targets, whole) in enumerate(aliases):
        test = f"contains(text, '{alias}')"
        if whole:
            test = f"regexp_matches(lower(text), '{_BORDER}{alias}{_BORDER_END}')"
        parts.append(
            f"select id, {i} as ord, string_split('{targets}', ',') as targets from {rel} where {test}"
        )
    return " union all ".join(parts)


def _places(rel: str, aliases) -> str:
    """(id, places) of (id, text): distinct targets in first-met order."""
    return f"""(select r.id, coalesce(p.places, '') as places from {rel} r left join (
      select id, string_agg(target, ',' order by ord, pos) as places from (
        select id, target, min(ord * 100 + pos) // 100 as ord, min(ord * 100 + pos) % 100 as pos from (
          select id, ord, unnest(targets) as target, unnest(range(len(targets))) as pos
          from ({_alias_hits(rel, aliases)}))
        group by id, target) group by id) p on p.id = r.id)"""


_JSON = r"nullif(regexp_extract(answer, '\[\s*\{.*?\}\s*\]', 0, 's'), '')"
_FOUND = f"coalesce({_JSON}, case when trim(answer) = '[]' then '[]' end)"

_CUE = r"^\d{2}:\d{2}:\d{2}\.\d{3}\s+-->\s+\d{2}:\d{2}:\d{2}\.\d{3}$"
_CUE_ANY = r"^(\d{2}:)?\d{2}:\d{2}[.,]\d{3}\s+-->\s+(\d{2}:)?\d{2}:\d{2}[.,]\d{3}(\s.*)?$"
_CUE_EXTRA = r"^(WEBVTT.*|\d+|(Kind|Language):.*)$"


def _cleaned(tests: list[str], line: str = "x") -> str:
    drop = " and ".join(f"not regexp_matches({line}, '{t}')" for t in tests)
    lines = f"string_split({_strip('value')}, chr(10))"
    kept = f"list_filter({lines}, lambda x: trim(x) <> '' and {drop})"
    return _strip(f"array_to_string({kept}, ' ')")


_HISTORY = """select conv_id, turn, role,
  string_agg(role || ': ' || text, chr(10)) over (partition by conv_id order by turn
  rows between unbounded preceding and current row) as messages from {rel}"""

_STOPPED = """(select c.* from conversations c left join (
    select conv_id, min(turn) as stop from conversations
    where {stop} group by conv_id) s using (conv_id) where stop is null or turn < stop)"""
_SYSTEM = """(select conv_id, turn, role, text from {rel} union all
  select conv_id, -1, 'system', 'Be brief.' from {rel} group by conv_id
  having max((role = 'system')::int) = 0)"""

ORACLES = {
    "payload_projection": f"""select {_ID} as id, name, cuisine, district, address,
      {_coordinate(1)} as latitude, {_coordinate(2)} as longitude, description_highlights,
      why_recommended, unique_tips, source_platform, source_title, source_url, channel_account,
      last_checked_date, cost_estimate_breakfast,
      {_lenient('cost_estimate_breakfast')} as parsed_cost_breakfast, cost_estimate_lunch,
      {_lenient('cost_estimate_lunch')} as parsed_cost_lunch, cost_estimate_dinner,
      {_lenient('cost_estimate_dinner')} as parsed_cost_dinner from {VENUES_SQL} v""",
    "record_payload": f"""select ord, {_strip('"Cost Estimate"')} as cost,
      {_strict('"Cost Estimate"')} as parsed, "Why Recommended" as why, 'Unknown' as source
      from {RECORDS_SQL} r""",
    "index_text": f"select ord, {_TEXT} as text from {VENUES_SQL} v",
    "record_text": "select ord, concat_ws(' ', "
    + ", ".join(f"coalesce({f}, '')" for f in _RECORD_FIELDS)
    + f") as text from {RECORDS_SQL} r",
    "sentence_template": f"""select ord, coalesce("Name", '') || ' in ' || coalesce("Location", '') ||
      ': ' || coalesce("Description/Highlights", '') || '. Why: ' || coalesce("Why Recommended", '') ||
      '. Cost: ' || coalesce("Cost Estimate", '') || '. Tips: ' || coalesce("Unique Tips", '') || '.'
      as sentence from {RECORDS_SQL} r""",
    "token_validation": f"""select ord, "Name" as name from {RECORDS_SQL} r where """
    + " and ".join(f'{_count(chr(34) + f + chr(34))} between {lo} and {hi}' for f, lo, hi in _BOUNDS),
    "validation_rejects": f"""select ord, reasons from (select ord, {_REASONS} as reasons
      from {RECORDS_SQL} r) where reasons <> ''""",
    "document_validation": f"""select doc_id, n from (select doc_id, {_count('text')} as n
      from documents) where n between 5 and 300""",
    "drop_empty": f"""select 'filled' as stage, count(*) filter (where coalesce({_strip('text')}, '') <> '')
      as n from documents union all
      select 'empty', count(*) filter (where coalesce({_strip('text')}, '') = '') from documents""",
    "url_mark": """select page_id, split_part(split_part(url, 'page=', 2), '&', 1) as value
      from pages where contains(url, 'page=')""",
    "url_param_top10": """select page_id, split_part(split_part(url, 'page=', 2), '&', 1) as value
      from (select * from pages order by page_id limit 20) where contains(url, '/en/')
      order by page_id limit 10""",
    "stage_counts": f"""select 0::bigint as step, 'read' as stage, count(*) as n from part
      union all select 1, 'deduplicated', count(distinct {_key('name')}) from {VENUES_SQL} v
      union all select 2, 'unnamed', count(*) from {VENUES_SQL} v where name is null
      union all select 3, 'valid', count(*) filter (where {_REASONS} = '') from {RECORDS_SQL} r
      union all select 4, 'bad', count(*) filter (where {_REASONS} <> '') from {RECORDS_SQL} r""",
    "query_text": """select item_id as query_id, trim(concat_ws(' ', text,
      case when item_id % 2 = 0 then '北區' end,
      case when item_id % 3 = 0 then 'HKD ' || item_id end)) as text from benchmark""",
    "query_source": "select item_id as query_id, length(text) as n from benchmark",
    "payload_without_vectors": "select vec_id, label::bigint as label from embeddings",
    "attach_vectors": """select doc_id, lang, source, quality::bigint as quality,
      toxic::bigint as toxic from documents join labels using (doc_id)""",
    "cost_lenient": "select ord, "
    + ", ".join(f"{_lenient(f'cost_estimate_{m}')} as {m}" for m in ("breakfast", "lunch", "dinner"))
    + f" from {VENUES_SQL} v",
    "cost_strict": "select ord, "
    + ", ".join(f"{_strict(f'cost_estimate_{m}')} as {m}" for m in ("breakfast", "lunch", "dinner"))
    + f" from {VENUES_SQL} v",
    "coordinates": f"""select ord, {_coordinate(1)} as latitude, {_coordinate(2)} as longitude
      from {VENUES_SQL} v""",
    "stable_id": f"select ord, {_ID} as id from {VENUES_SQL} v",
    "normal_key": f"select ord, {_key('name')} as key from {VENUES_SQL} v",
    "accent_fold": rf"""select doc_id, folded from (select doc_id,
      regexp_replace(strip_accents({_key('text')}), '[^\x00-\x7f]', '', 'g') as folded
      from documents) where folded <> ''""",
    "word_tokens": f"""select doc_id, count(*) as n, count(distinct t) as kinds, min(t) as first,
      max(t) as last from (select doc_id, unnest({_tokens('text')}) as t from documents)
      group by doc_id""",
    "char_ngrams": f"""select term, count(*) as df, sum(tf)::bigint as cf
      from {_gram_counts('documents')} group by term""",
    "clean_captions": f"select doc_id, {_cleaned([_CUE])} as text from {CAPTIONS_SQL} c",
    "clean_captions_strict": "select doc_id, "
    + _cleaned([_CUE_ANY, _CUE_EXTRA], "rtrim(x)")
    + f" as text from {CAPTIONS_SQL} c",
    "snippets": "select doc_id, replace(substr(text, 1, 100), chr(10), ' ') as snippet from documents",
    "unit_vectors": """select vec_id, pos, round(x / size, 6) as x from (
      select vec_id, unnest(range(len(v))) as pos, unnest(v) as x, sqrt(list_inner_product(v, v)) as size
      from (select vec_id, list_transform(embedding, lambda x: x::double * (1 + label))::double[] as v
            from embeddings))""",
    "cosine_neighbours": f"""select a.vec_id, {_COS.format(a='a.embedding', b='b.embedding')} as score
      from embeddings a join embeddings b on b.vec_id = a.vec_id + 1""",
    "vector_lengths": """select vec_id, round(sqrt(list_inner_product(embedding::double[],
      embedding::double[])), 6) as length from embeddings""",
    "dedup_keep_last": f"""select ord, name, district from (select *, row_number() over (
      partition by {_key('name')} order by ord desc) as r from {VENUES_SQL} v) where r = 1""",
    "csv_venues": f"""select * exclude (ord, r) replace (nullif(unique_tips, '') as unique_tips) from (select *, row_number() over (
      partition by {_key('name')} order by ord desc) as r from {VENUES_SQL} v) where r = 1""",
    "dedup_name_district": f"""select ord, name, district from (select *, row_number() over (
      partition by {_key('name')}, {_key('district')} order by ord desc) as r from {VENUES_SQL} v)
      where r = 1""",
    "upsert_merge": f"""with v as (select {_ID} as id, * from {VENUES_SQL} v),
      latest as (select id, address, row_number() over (partition by id order by ord desc) as r from v),
      sent as (select id, 'moved to ' || address as address,
        row_number() over (partition by id order by ord desc) as r from v where address is not null)
      select id, address from latest where r = 1 and id not in (select id from sent)
      union all select id, address from sent where r = 1""",
    "similar_pairs": f"with {_pairs(_EMB, 0.377)} select a, b, score from pairs",
    "similar_pairs_default": f"with v as materialized {_COPIES}, {_pairs('v', 0.85)} select a, b from pairs",
    "near_dup_groups": f"{_NEAR} select leader, id from grouped",
    "near_dup_leaders": f"{_NEAR} select leader, count(*) as n from grouped group by leader",
    "near_dup_best": f"{_NEAR}, {_BEST} select leader, keep from best",
    "near_dup_keep": f"""{_NEAR}, {_BEST} select keep as id from best union
      select vec_id from embeddings where vec_id not in (select id from grouped)""",
    "ungrouped_rows": f"""{_NEAR} select vec_id as id from embeddings
      where vec_id not in (select id from grouped)""",
    "text_copy_groups": f"""with recursive b as materialized {_buckets('documents')},
      v as materialized (select doc_id as id, embedding from {_hashed('b')}), {_pairs('v', 0.995)},
      {_GROUPS} select leader, id from grouped""",
    "doc_frequency": f"""select term, count(*) as df, sum(tf)::bigint as cf,
      round(ln((1 + ({_N_DOCS}))::double / (count(*) + 1)) + 1, 6) as idf
      from {_word_counts('documents')} group by term""",
    "vocabulary": f"with {_WORD_MODEL} select term, term_id, df, round(idf, 6) as idf from vocab",
    "tfidf_weights": f"with {_WORD_MODEL} select doc_id, term_id, round(weight, 6) as weight from weights",
    "sparse_vectors": f"""with {_WORD_MODEL} select doc_id, count(*) as n, min(term_id) as first_id,
      max(term_id) as last_id, round(arg_min(weight, term_id), 6) as first_weight
      from weights group by doc_id""",
    "sparse_topk": f"with {_WORD_MODEL}, {_ASKED_WEIGHTS} {_sparse(10)}",
    "sparse_join_topk": f"with {_WORD_MODEL}, {_ASKED_WEIGHTS} {_sparse(10)}",
    "char_sparse_topk": f"""with {_model(_gram_counts('documents'), _N_DOCS, 100_000)},
      asked as materialized ({_weights(_gram_counts(_ASKED))}) {_sparse(10)}""",
    "dense_topk": _dense(10),
    "dense_filtered_topk": _dense(10, True),
    "filtered_topk": f"with {_WORD_MODEL}, {_ASKED_WEIGHTS} {_sparse(10, True)}",
    "candidate_lists": f"{_candidates(30)} select * from candidates",
    "list_statistics": f"""{_candidates(30)} select list, query_id, round(avg(score), 6) as mean,
      round(stddev_samp(score), 6) as deviation from candidates group by list, query_id""",
    "hybrid_rrf": f"{_candidates(30)} {_ranked(_RRF, 10)}",
    "hybrid_dbsf": f"{_candidates(30)} {_ranked(_DBSF, 10)}",
    "filtered_hybrid": f"{_candidates(9, True)} {_ranked(_RRF, 3)}",
    "sparse_fused": f"{_SPARSE_FUSED} {_ranked(_RRF, 3)}",
    "display_rows": f"""{_SPARSE_FUSED} select query_id, rank, lang, source,
      printf('%.4f', score) as score, replace(substr(text, 1, 100), chr(10), ' ') || '...' as snippet
      from ({_ranked(_RRF, 3)}) join documents using (doc_id)""",
    "source_topk": """select doc_id, source, n_chars, rank from (select *, row_number() over (
      partition by source order by n_chars desc, doc_id) as rank from documents) where rank <= 3""",
    "alias_lookup": f"""select id as query_id, places
      from {_places('(select item_id as id, text from benchmark)', _ALIASES)}""",
    "alias_lookup_documents": f"""select id as doc_id, places
      from {_places('(select doc_id as id, text from documents)', _ALIASES)}""",
    "alias_lookup_table": f"""with planted as materialized (select doc_id as id, text || ' ' ||
        [{', '.join(f"'{name}'" for name, _, _ in _HONG_KONG)}][doc_id % {len(_HONG_KONG)} + 1] as text from documents)
      select id as doc_id, places from {_places('planted', _HONG_KONG)}""",
    "venue_search": f"""with kept as materialized (
        select {_ID} as doc_id, name, district, {_TEXT} as text from (
          select *, row_number() over (partition by {_key('name')}, {_key('district')}
            order by ord desc) as r from {VENUES_SQL} v) where r = 1),
      {_model(_gram_counts('kept'), 'select count(*) from kept', 100_000)},
      questions as materialized (select min(p_partkey) as doc_id, p_name as text from part group by p_name),
      asked as materialized ({_weights(_gram_counts('questions'))}),
      tagged as materialized (select id, places
        from {_places('(select doc_id as id, text from questions)', _BRANDS)}),
      scores as materialized (select q.doc_id as query_id, w.doc_id,
        round(sum(q.weight * w.weight), 6) as score
        from asked q join tagged t on t.id = q.doc_id join weights w using (term_id)
        join kept k on k.doc_id = w.doc_id
        where places = '' or list_contains(string_split(places, ','), k.district) group by all),
      candidates as (select 'sparse' as list, * from ({_ranked('scores', 9)}))
      select query_id, rank, doc_id as id, score, name, district
      from ({_ranked(_RRF, 3)}) join kept using (doc_id)""",
    "json_records": f"""with found as (select doc_id, {_FOUND} as j from {ANSWERS_SQL} a),
      lists as (select doc_id, unnest(from_json(j, '["json"]')) as x,
        unnest(range(json_array_length(j)::bigint)) as pos from found
        where case when json_valid(j) then json_type(j) = 'ARRAY' else false end)
      select doc_id, pos, x ->> '$.Name' as name, x ->> '$.Location' as location,
        x ->> '$."Cost Estimate"' as cost, x ->> '$."Description/Highlights"' as highlights from lists""",
    "parse_rejects": f"""select doc_id, answer from (select doc_id, answer, {_FOUND} as j
      from {ANSWERS_SQL} a) where j is null or not json_valid(j)""",
    "event_properties": "select event_id, (props ->> '$.k')::bigint as k from events",
    "chunks": """select doc_id, pos, substr(text, (pos * 500 + 1)::int, 500) as piece from (
      select doc_id, text, unnest(range(greatest(1, ceil(length(text) / 500.0)::bigint))) as pos
      from documents)""",
    "chunk_rejoin": "select doc_id, text from documents",
    "hashed_buckets": f"select doc_id, bucket, n from {_buckets('documents')} h",
    "hashed_encoder": f"""with b as materialized {_buckets(_ASKED)} select doc_id,
      unnest(range(256)) as pos, round(unnest(embedding)::double, 5) as x from {_hashed('b')}""",
    "hashed_search": f"""with b as materialized {_buckets('documents')},
      c as materialized {_buckets(_ASKED)},
      s as (select q.doc_id as query_id, d.doc_id,
        {_COS.format(a='d.embedding', b='q.embedding')} as score
        from {_hashed('b')} d cross join {_hashed('c')} q)
      select query_id, rank, round(score, 4) as score from ({_ranked('s', 5)})""",
    "context_prompt": f"""select item_id as query_id, 'Wanted: ' || b.text || chr(10) || 'Passages:' ||
      chr(10) || context || chr(10) || 'Answer:' as prompt from benchmark b join (
        select query_id, string_agg(text, chr(10) || chr(10) order by rank) as context
        from ({_dense(5, vectors=_EMBEDDED)}) h join documents using (doc_id) group by query_id) c
      on c.query_id = b.item_id""",
    "history_prefix": f"select * exclude (role) from ({_HISTORY.format(rel='conversations')})",
    "history_small_blocks": f"select * exclude (role) from ({_HISTORY.format(rel='conversations')})",
    "history_blocks": """select conv_id, turn // 4 as block, min(turn) as first_turn,
      string_agg(role || ': ' || text, chr(10) order by turn) as messages
      from conversations group by conv_id, turn // 4""",
    "stop_marker": "select conv_id, turn, role from "
    + _STOPPED.format(stop="role = 'assistant' and length(text) < 120"),
    "system_first": "select * from " + _SYSTEM.format(rel="conversations"),
    "chat_requests": f"""with kept as materialized {_STOPPED.format(stop="lower(trim(text)) = 'exit'")}
      select conv_id, turn, messages from ({_HISTORY.format(rel=_SYSTEM.format(rel='kept'))})
      where role = 'user'""",
    "district_filter": """select 'any' as form, doc_id from documents
      where source in ('src1', 'src3', 'src5')
      union all select 'one', doc_id from documents where source = 'src2'
      union all select 'none', doc_id from documents""",
    "stream_history": f"""select * exclude (role), false as late
      from ({_HISTORY.format(rel='conversations')})""",
    "stream_points": f"""with all_texts as materialized (
        select {_ID} as doc_id, name, address, ord, {_TEXT} as text from {VENUES_SQL} v),
      {_model(_gram_counts('all_texts'), 'select count(*) from all_texts', 100_000)},
      kept as materialized (select * from (select *, row_number() over (
        partition by doc_id order by ord desc) as r from all_texts) where r = 1)
      select k.doc_id as id, any_value(name) as name, any_value(address) as address,
        count(v.term) as n_terms
      from kept k left join {_gram_counts('kept')} g using (doc_id) left join vocab v using (term)
      group by k.doc_id""",
}
