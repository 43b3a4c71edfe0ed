"""The registered queries of the operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablequill.llm import (
    bloom_lines,
    gam,
    jump_shards,
    license_scan,
    lsh_forest,
    mixing,
    packing,
    prefix_audit,
    records,
    rmq_search,
    rule_ledger,
    subspace_join,
    toxicity,
)
from tablequill.session import fresh_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.op1_rows(_documents(spark, sf_dir))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op2_rows(_documents(spark, sf_dir), _table(spark, sf_dir, "labels"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    return records.op3_rows(_documents(spark, sf_dir), fresh_path(spark, "records"), tokenizer)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh_forest.op4_rows(_documents(spark, sf_dir))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subspace_join.op5_rows(_table(spark, sf_dir, "embeddings"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op6_rows(_documents(spark, sf_dir))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jump_shards.op7_rows(_documents(spark, sf_dir))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_ledger.op8_rows(_documents(spark, sf_dir))


def op8_policy3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_ledger.op8_rows(_documents(spark, sf_dir), version=3)


def op8_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of each policy rejects, from one stored ledger."""
    stored = rule_ledger.store(_documents(spark, sf_dir))
    parts = [
        rule_ledger.ablations(stored, v).select(F.lit(v).alias("policy"), "*") for v in rule_ledger.POLICIES
    ]
    return reduce(DataFrame.unionByName, parts)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return packing.op9_rows(_documents(spark, sf_dir), tokenizer)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gam.op10_rows(_documents(spark, sf_dir), _table(spark, sf_dir, "labels"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rmq_search.op11_rows(_documents(spark, sf_dir), _table(spark, sf_dir, "benchmark"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloom_lines.op12_rows(_documents(spark, sf_dir))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_audit.op13_rows(_documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1,
    "op2_toxicity": op2,
    "op3_token_records": op3,
    "op4_lsh_forest": op4,
    "op5_subspace_join": op5,
    "op6_mixing": op6,
    "op7_jump_shards": op7,
    "op8_rule_ledger": op8,
    "op9_best_two_fit": op9,
    "op10_gam_quality": op10,
    "op11_rmq_search": op11,
    "op12_bloom_lines": op12,
    "op13_prefix_audit": op13,
}
# Other versions of an operator's query.
VERSIONS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op8_rule_ledger_policy3": op8_policy3,
    "op8_rule_ledger_ablations": op8_ablations,
}

_LINKS_SQL = """
with recursive
  words as (
    select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents
  ),
  shingles as (
    select distinct doc_id, unnest(case
      when len(w) = 0 then []
      when len(w) < 5 then [array_to_string(w, ' ')]
      else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as s
    from words
  ),
  sizes as (select doc_id, count(*) as n from shingles group by doc_id),
  shared as (
    select a.doc_id as x, b.doc_id as y, count(*) as n
    from shingles a join shingles b on a.s = b.s and a.doc_id <> b.doc_id group by all
  ),
  links as (
    select x, y from shared join sizes p on p.doc_id = x join sizes q on q.doc_id = y
    where shared.n >= 0.8 * (p.n + q.n - shared.n) - 1e-9
  ),
  reach as (
    select doc_id as x, doc_id as y from documents
    union
    select reach.x, links.y from reach join links on reach.y = links.x
  ),
  classes as (select x as doc_id, min(y) as class_id from reach group by x),
  degrees as (select x as doc_id, count(*) as n_links from links group by x)
select doc_id, class_id, coalesce(n_links, 0) as n_links, doc_id = class_id as kept
from documents join classes using (doc_id) left join degrees using (doc_id)
"""

_VECTORS_SQL = """
with recursive
  unit as (
    select vec_id, label, embedding::double[] as v from embeddings
    where label is not null and embedding is not null
      and list_dot_product(embedding::double[], embedding::double[]) > 0
  ),
  links as (
    select a.vec_id as x, b.vec_id as y from unit a
    join unit b on a.label = b.label and a.vec_id <> b.vec_id and len(a.v) = len(b.v)
    where list_cosine_similarity(a.v, b.v) >= 0.93
  ),
  reach as (
    select vec_id as x, vec_id as y from embeddings
    union
    select reach.x, links.y from reach join links on reach.y = links.x
  ),
  classes as (select x as vec_id, min(y) as component_id from reach group by x),
  degrees as (select x as vec_id, count(*) as n_links from links group by x)
select vec_id, coalesce(n_links, 0) as n_links, component_id, vec_id = component_id as kept
from embeddings join classes using (vec_id) left join degrees using (vec_id)
"""

_MIX_SQL = """
with
  docs as (
    select doc_id, source, coalesce(md5(text), '') as hash,
      coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size,
      greatest(0.05, 1 - 4 * (coalesce(length(text) - length(translate(text, '#*$%&|<>!', '')), 0)::double
        / greatest(coalesce(length(text), 0), 1))) as weight,
      (('0x' || substr(md5('11:' || coalesce(doc_id::varchar, '') || ':' || coalesce(md5(text), '')), 1, 13))::bigint + 0.5)
        / 4503599627370496.0::double as u
    from documents
  ),
  sums as (select source, sum(size)::bigint as source_size from docs group by source),
  placed as (
    select *, row_number() over (order by encode(source) nulls last) - 1 as place from sums
  ),
  weighed as (
    select *, [5, 2, 1][(place % 3 + 1)::int] as w, 2 * source_size as cap,
      (sum(source_size) over ()) * 1.5::double as total
    from placed
  ),
  levels as (
    select *,
      (total - coalesce(sum(cap) over (order by cap / w::double, place
          rows between unbounded preceding and 1 preceding), 0)::double)
      / ((sum(w) over ()) - coalesce(sum(w) over (order by cap / w::double, place
          rows between unbounded preceding and 1 preceding), 0))::double as level
    from weighed
  ),
  goals as (
    select source, source_size,
      least(cap::double, coalesce((select arg_min(level, struct_pack(a := cap / w::double, b := place))
        from levels where level * w <= cap) * w, cap::double)) as target
    from levels
  ),
  ranked as (
    select doc_id, source, size,
      coalesce(sum(size) over (partition by source order by -ln(u) / weight, doc_id nulls first, hash
        rows between unbounded preceding and 1 preceding), 0) as first
    from docs
  ),
  parts as (
    select doc_id, size, source_size, target, first,
      floor(target / greatest(source_size, 1))::bigint as epochs
    from ranked join goals on ranked.source is not distinct from goals.source
  )
select doc_id, size, source_size, target,
  (epochs * size + greatest(0, least(size, floor(target)::bigint - epochs * source_size - first)))::bigint
    as taken
from parts
"""

_RULES_SQL = """
with
  docs as (
    select doc_id, coalesce(text, '') as text,
      regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w
    from documents
  ),
  windows as (
    select doc_id, unnest(range(1, len(w) - 3)) as i,
      unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) as s
    from docs where len(w) >= 5
  ),
  found as (select doc_id, i, count(*) over (partition by doc_id, s) as n from windows),
  covered as (
    select doc_id, count(distinct p) as n_repeat_words
    from (select doc_id, unnest(range(i, i + 5)) as p from found where n > 1) group by doc_id
  ),
  lines as (
    select doc_id, unnest(string_split(text, chr(10))) as line from docs
  ),
  line_counts as (
    select doc_id, count(*) as n_lines, count(*) - count(distinct line) as n_dup_lines
    from lines where regexp_matches(line, '[^\\x20\\x09-\\x0D]') group by doc_id
  ),
  measured as (
    select doc_id, len(w)::bigint as n_words,
      length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g'))::bigint as word_chars,
      (length(text) - length(translate(text, '#*$%&|<>', '')))::bigint as n_symbols,
      coalesce(n_dup_lines, 0)::bigint as n_dup_lines,
      coalesce(n_repeat_words, 0)::bigint as n_repeat_words,
      coalesce(n_lines, 0) as n_lines, len(list_distinct(w)) as n_distinct_words,
      length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) as n_upper,
      length(text) - length(regexp_replace(text, '[a-z]', '', 'g')) as n_lower,
      length(text) - length(translate(text, '!?', '')) as n_marks
    from docs left join line_counts using (doc_id) left join covered using (doc_id)
  ),
  ledger as (
    select *, (
      (n_words < 10)::bigint
      + 2 * (100 * n_repeat_words > 20 * n_words)::bigint
      + 4 * (10 * n_symbols > n_words)::bigint
      + 8 * (2 * n_marks > n_words)::bigint
      + 16 * (2 * n_upper > n_upper + n_lower and n_upper > 20)::bigint
      + 32 * (n_words >= 20 and 10 * n_distinct_words < 3 * n_words)::bigint
      + 64 * (n_lines >= 4 and 2 * n_dup_lines > n_lines)::bigint
      + 128 * (word_chars < 2 * n_words or word_chars > 15 * n_words)::bigint)::bigint as fail_bits
    from measured
  )
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (fail_bits & 3) <> 0 as base_failed, fail_bits = 0 as kept, fail_bits
from ledger
"""

# Policy 4: distinct words are counted in windows of 1000 words, not in the whole text.
_RULES4_SQL = (
    _RULES_SQL.replace(
        "as n_distinct_words,",
        "as n_distinct_words,\n      coalesce(list_sum(list_transform(range(0, len(w), 1000),"
        " lambda i: len(list_distinct(w[i + 1:i + 1000])))), 0) as n_window_words,",
    )
    .replace(
        "word_chars > 15 * n_words)::bigint)",
        "word_chars > 15 * n_words)::bigint\n"
        "      + 256 * (n_words >= 20 and 10 * n_window_words < 3 * n_words)::bigint)",
    )
    .replace("fail_bits = 0 as kept", "(fail_bits & 479) = 0 as kept")
)

_ABLATIONS_SQL = (
    _RULES4_SQL[: _RULES4_SQL.rindex("select doc_id, n_words")].rstrip()
    + """,
  policies as (select unnest([{'policy': 1, 'mask': 3}, {'policy': 2, 'mask': 31},
    {'policy': 3, 'mask': 255}, {'policy': 4, 'mask': 479}], recursive := true)),
  rules as (select unnest(range(9)) as bit, unnest(['few_words', 'repeated_windows', 'symbols', 'marks',
    'capitals', 'few_distinct_words', 'duplicate_lines', 'word_length', 'few_distinct_in_windows']) as rule)
select policy, rule, count(*) filter (fail_bits & (1 << bit) <> 0) as failed,
  count(*) filter (fail_bits & mask = (1 << bit)) as only
from policies join rules on mask & (1 << bit) <> 0, ledger group by policy, rule
"""
)

_SEARCH_SQL = """
with
  texts as (
    select doc_id, regexp_extract_all(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as w
    from documents
  ),
  docs as (select row_number() over () as d, doc_id, w, len(w) as n from texts),
  totals as (select count(*) filter (n > 0) as n_docs, sum(n)::bigint as n_terms from docs),
  items as (
    select row_number() over () as q, item_id, regexp_extract_all(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as w
    from benchmark
  ),
  asked as (
    select q, item_id, term, count(*) as times
    from (select q, item_id, unnest(w) as term from items) group by all
  ),
  occurrences as (select d, doc_id, n, unnest(w) as term from docs),
  postings as (
    select d, doc_id, n, term, count(*) as tf from occurrences
    where term in (select term from asked) group by all
  ),
  weights as (
    select term, floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1)))::bigint as weight
    from postings, totals group by term
  ),
  scores as (
    select q, item_id, d, doc_id, sum(times * weight
      * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms))))::bigint as score
    from asked join postings using (term) join weights using (term), totals
    group by q, item_id, d, doc_id
  ),
  ranked as (
    select *, row_number() over (partition by q order by score desc, doc_id nulls last)::int as rank
    from scores where score > 0
  )
select item_id, rank, doc_id, score from ranked where rank <= 10
"""

_LINES_SQL = """
with
  docs as (select row_number() over () as d, doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents),
  lines as (select d, unnest(l) as line, unnest(range(len(l))) as i from docs),
  keyed as (
    select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
    from lines
  ),
  dropped as (select key from keyed where key <> '' group by key having count(distinct d) >= 10),
  judged as (select *, key in (select key from dropped) as gone from keyed),
  kept as (
    select d, count(*) as n_lines, count(*) filter (gone) as n_dropped,
      coalesce(string_agg(line, chr(10) order by i) filter (not gone), '') as text
    from judged group by d
  )
select doc_id, n_lines, n_dropped, sha256(text) as kept_sha256 from docs join kept using (d)
"""

_AUDIT_SQL = """
with
  docs as (
    select row_number() over () as d, coalesce(lang, '') as lang, coalesce(source, '') as source,
      regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as w
    from documents
  ),
  found as (
    select lang, source, d, term, count(*) as n
    from (select lang, source, d, unnest(w) as term from docs) group by all
  ),
  kept as (select lang, term from found group by lang, term having count(*) >= 10),
  counts as (
    select lang, source, term, sum(n)::bigint as n from found join kept using (lang, term) group by all
  ),
  groups as (select distinct lang, source from docs),
  vocabulary as (select lang, count(*) as v from kept group by lang),
  totals as (select lang, source, sum(n)::bigint as total from counts group by all),
  shares as (
    select g.lang, g.source, k.term, coalesce(c.n, 0) as n,
      1 + (1000000000 * (coalesce(c.n, 0) + 2)) // (coalesce(total, 0) + 2 * v) as p
    from groups g join kept k using (lang) join vocabulary using (lang)
    left join totals using (lang, source) left join counts c using (lang, source, term)
  ),
  lang_counts as (select lang, term, sum(n)::bigint as n from counts group by all),
  lang_totals as (select lang, sum(n)::bigint as total from lang_counts group by lang),
  lang_shares as (
    select lang, term, 1 + (1000000000 * (n + 2)) // (total + 2 * v) as q
    from lang_counts join lang_totals using (lang) join vocabulary using (lang)
  ),
  distances as (
    select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p))::bigint as value
    from shares a join shares b on a.lang = b.lang and a.term = b.term and a.source <> b.source
    group by all
  ),
  pairs as (
    select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0)::bigint as value
    from groups a join groups b on a.lang = b.lang and a.source <> b.source
    left join distances d on d.lang = a.lang and d.source = a.source and d.item = b.source
  ),
  terms as (
    select lang, source, 'term' as part, term as item, (((p - q) * (p - q)) // (p + q))::bigint as value
    from shares join lang_shares using (lang, term) where n > 0 and p > q
  ),
  ranked as (
    select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank
    from (select * from pairs union all select * from terms)
  )
select lang, source, part, item, value, rank from ranked where part = 'pair' or rank <= 10
"""

ORACLES = {
    "op4_lsh_forest": _LINKS_SQL,
    "op5_subspace_join": _VECTORS_SQL,
    "op6_mixing": _MIX_SQL,
    "op8_rule_ledger": _RULES4_SQL,
    "op8_rule_ledger_policy3": _RULES_SQL,
    "op8_rule_ledger_ablations": _ABLATIONS_SQL,
    "op11_rmq_search": _SEARCH_SQL,
    "op12_bloom_lines": _LINES_SQL,
    "op13_prefix_audit": _AUDIT_SQL,
}
