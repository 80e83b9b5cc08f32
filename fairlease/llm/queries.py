"""The thin ``opN_<name>`` queries over the driver's tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fairlease.llm import ann, jaccard, language, omh, packing, periodic, pieces, secrets, sharding, spelling, suffix, toxicity, url_trust
from fairlease.llm.shared import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify_documents(table(spark, sf_dir, "documents"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_trust.judge_pages(table(spark, sf_dir, "pages"))


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join_documents(table(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.removed_documents(table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_layout(table(spark, sf_dir, "documents"), [1.0] * 16)


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return omh.fingerprint_documents(table(spark, sf_dir, "documents"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.repeated_runs(table(spark, sf_dir, "documents"))


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_documents(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_toxicity": op1_toxicity,
    "op2_language_id": op2_language_id,
    "op3_url_filters": op3_url_filters,
    "op4_packing": op4_packing,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_sharding": op7_sharding,
    "op8_nearest": op8_nearest,
    "op9_fingerprints": op9_fingerprints,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_spelling": op11_spelling,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_secrets": op13_secrets,
}

#: Steps after which the SQL takes the ranks as converged: 2 ** -200 of the mass is left.
_STEPS, _DAMPING = 200, 0.5


def _rules_sql() -> str:
    arms = []
    for r in sorted(url_trust.RULES, key=lambda r: (-len(r.name), -len(r.host))):
        arms.append(f"when (host = '{r.host}' or host like '%.{r.host}') and starts_with(path, '{r.path}') then '{r.verdict}:{r.name}'")
    return "case " + " ".join(arms) + " end"


def _trust_sql() -> str:
    rest = "case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) end"
    lower = f"translate(regexp_extract({{}}, '^([^/?#]*)', 1), '{url_trust.UPPER}', '{url_trust.LOWER}')"
    return f"""
with recursive parts as (select page_id, html, coalesce({lower.format("rest")}, '') host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') path from (select *, {rest} rest from pages)),
judged as materialized (select *, {_rules_sql()} ruling from parts),
hrefs as (select distinct page_id, host src, unnest(regexp_extract_all(coalesce(html, ''), '<a[[:space:]][^>]*?href[[:space:]]*=[[:space:]]*["'']?([^"''[:space:]>]+)', 1, 'i')) link from judged),
targets as (select distinct page_id, src, case when regexp_matches(link, '^([A-Za-z][A-Za-z0-9+.-]*:)?//') then {lower.format("substr(link, instr(link, '//') + 2)")} else src end dst from hrefs),
links as (select src, dst, count(*) weight from targets where src <> '' and dst <> '' group by 1, 2),
both_ways as (select 'trust' kind, src, dst, weight from links union all select 'distrust', dst, src, weight from links),
edges as materialized (select kind, src, dst, weight / sum(weight) over (partition by kind, src) share from both_ways),
counts as (select case when starts_with(ruling, 'allow') then 'trust' else 'distrust' end kind, host, count(*) pages from judged where ruling is not null group by 1, 2),
seeds as materialized (select kind, host, pages / sum(pages) over (partition by kind) seed from counts),
fronts(kind, host, step, rank) as (
  select kind, host, 0, seed * (1 - {_DAMPING}) from seeds
  union all select e.kind, e.dst, f.step + 1, {_DAMPING} * sum(f.rank * e.share) from fronts f join edges e on e.kind = f.kind and e.src = f.host where f.step < {_STEPS} group by 1, 2, 3
),
margin as (select host, sum(rank) filter (kind = 'trust') t, sum(rank) filter (kind = 'distrust') d from fronts group by host)
select page_id, host, path, split_part(ruling, ':', 2) as rule,
  coalesce(split_part(ruling, ':', 1), case when coalesce(d - t > {url_trust.EVEN} * (d + t), d is not null) then 'block' else 'allow' end) verdict
from judged left join margin using (host)
"""


_JACCARD_SQL = r"""
with recursive words as (
  select doc_id, [x for x in regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') if x <> ''] w from documents
), shingles as materialized (
  select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else [array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)] end) s from words
), sizes as materialized (select doc_id, count(*) n from shingles group by 1),
pairs as (select a.doc_id x, b.doc_id y, count(*) k from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
links as materialized (
  select x, y from pairs join sizes a on a.doc_id = x join sizes b on b.doc_id = y where 100 * k >= 75 * (a.n + b.n - k)
), ways as materialized (select x, y from links union all select y, x from links),
reach(doc_id, r) as (select doc_id, doc_id from sizes union select reach.doc_id, ways.y from reach join ways on ways.x = reach.r)
select d.doc_id, coalesce(any_value(n), 0)::bigint n_shingles, coalesce(min(r), d.doc_id)::bigint component_id
from documents d left join sizes s on s.doc_id = d.doc_id left join reach on reach.doc_id = d.doc_id group by d.doc_id
"""

_SUFFIX_SQL = """
with bytes as materialized (select doc_id, hex(encode(coalesce(text, ''))) h, octet_length(encode(coalesce(text, ''))) n from documents),
windows as (select doc_id, i, md5_number(substr(h, 2 * i + 1, 200)) w from (select doc_id, h, unnest(range(0, n - 99)) i from bytes where n >= 100)),
again as materialized (select doc_id, i from (select doc_id, i, row_number() over (partition by w order by doc_id, i) k from windows) where k > 1),
islands as (select doc_id, i, sum(case when i <= before + 100 then 0 else 1 end) over (partition by doc_id order by i) island from (select *, lag(i) over (partition by doc_id order by i) before from again)),
spans as materialized (select doc_id, min(i) a, max(i) + 100 z from islands group by doc_id, island),
gaps as (
  select doc_id, coalesce(lag(z) over (partition by doc_id order by a), 0) a, a z from spans
  union all select b.doc_id, coalesce(max(s.z), 0), any_value(b.n) from bytes b left join spans s on s.doc_id = b.doc_id group by b.doc_id
),
kept as (select g.doc_id, string_agg(substr(h, 2 * a + 1, 2 * (z - a)), '' order by a) h from gaps g join bytes b on b.doc_id = g.doc_id group by g.doc_id),
summed as (select doc_id, sum(z - a) n_removed, count(*) n_spans from spans group by doc_id)
select b.doc_id, b.n::bigint n_bytes, coalesce(n_removed, 0)::bigint n_removed, coalesce(n_spans, 0)::bigint n_spans, sha256(unhex(k.h)) kept_sha256
from bytes b join kept k on k.doc_id = b.doc_id left join summed s on s.doc_id = b.doc_id
"""

#: Exact search; small tables are searched whole, so it is what the forest returns there.
_NEAREST_SQL = """
with v as (
  select vec_id, embedding::double[] e from embeddings
  where embedding is not null and len([x for x in embedding if x is null or isnan(x) or isinf(x)]) = 0 and len([x for x in embedding if x <> 0]) > 0
), scored as (select q.vec_id query_id, c.vec_id, list_inner_product(q.e, c.e) score from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0)
select query_id, rank, vec_id, score from (select *, row_number() over (partition by query_id order by score desc, vec_id)::int rank from scored) where rank <= 20
"""

#: The checksum's table of 256 entries, from its polynomial; ``tab.t`` is read by ``_crc32_sql``.
_CRC_TABLE = """crc_bits(i, c, k) as (
  select i, i::bigint, 0 from range(256) r(i) union all select i, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from crc_bits where k < 8
), tab as materialized (select list(c order by i) t from crc_bits where k = 8)"""


def _crc32_sql(text: str) -> str:
    """The unsigned CRC-32 of a string's UTF-8 bytes, beside a table ``tab``."""
    digit = lambda at: f"strpos('0123456789ABCDEF', hex(encode({text}))[{at}]) - 1"
    octets = f"list_transform(range(1, octet_length(encode({text})) + 1), lambda i: ({digit('2 * i - 1')}) * 16 + ({digit('2 * i')}))"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {octets}), lambda c, v: xor(c >> 8, t[(xor(c, v) & 255) + 1])), 4294967295)"


_SPELLING_SQL = f"""
with recursive {_CRC_TABLE},
runs as (select coalesce(doc_id::varchar, '') || ':' id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), '{url_trust.UPPER}', '{url_trust.LOWER}') run from documents),
counted as materialized (select id, run, count(*) k from runs where length(run) >= 7 group by 1, 2),
hashed as (select run, k, {_crc32_sql("id || run")} h from counted, tab),
cut as (select case when h % 31 = 0 then substr(run, 1, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end word, k from hashed),
words as materialized (select word, sum(k)::bigint n from cut where length(word) >= 7 group by 1 having sum(k) >= 2),
places as (select word, unnest(range(0, length(word) + 1)) i from words),
replaced as (select word, i, substr(word, 1, i) || '?' || substr(word, i + 2) as k from places where i < length(word)),
deleted as (select distinct word, substr(word, 1, i) || substr(word, i + 2) shorter from places where i < length(word)),
pairs as materialized (
  select a.word x, b.word y from replaced a join replaced b on a.k = b.k and a.i = b.i and a.word <> b.word
  union all select d.word, w.word from deleted d join words w on w.word = d.shorter
  union all select w.word, d.word from deleted d join words w on w.word = d.shorter
), ranked as (
  select x, y, b.n, count(*) over (partition by x) n_near, row_number() over (partition by x order by b.n desc, encode(y)) r from pairs join words b on b.word = y
), forms as materialized (
  select w.word, w.n, coalesce(n_near, 0)::bigint n_near, case when r.n >= 10 * w.n then y end form, case when r.n >= 10 * w.n then r.n end form_n
  from words w left join ranked r on r.x = w.word and r.r = 1
), chains(word, held) as (select word, word from forms union all select c.word, f.form from chains c join forms f on f.word = c.held where f.form is not null)
select f.word, f.form, c.held as root, f.n, f.n_near, f.form_n::bigint form_n
from forms f join chains c on c.word = f.word join forms e on e.word = c.held where e.form is null
"""

_PERIODIC_SQL = rf"""
with recursive {_CRC_TABLE},
split as materialized (select row_number() over () rid, doc_id, [x for x in regexp_split_to_array(coalesce(text, ''), '[ 	-
]+') if x <> ''] w from documents),
sums as (select *, len(w) n, {_crc32_sql("coalesce(doc_id::varchar, '')")} h from split, tab),
marks as (select *, case when h % 10 = 0 and n > 0 then (h // 10) % n end a from sums),
periods as (select *, 1 + (n - a) // (3 + (h // 10) % 8) p from marks),
planted as materialized (select rid, doc_id, n, case when a is null then w else list_transform(range(0, n), lambda i: w[case when i < a then i else a + (i - a) % p end + 1]) end w from periods),
words as materialized (select rid, unnest(range(0, n)) i, unnest(w) word from planted),
grams as materialized (select rid, n, i, md5(array_to_string(w[i + 1:i + 16], ' ')) g from (select rid, n, w, unnest(range(0, n - 15)) i from planted where n >= 16)),
pairs as (select a.rid, b.i - a.i q, a.i from grams a join grams b on b.rid = a.rid and b.g = a.g and b.i > a.i and 3 * (b.i - a.i) <= a.n),
islands as (select rid, q, i, i - row_number() over (partition by rid, q order by i) island from pairs),
stretches as (select rid, q, min(i) s, count(*) + 15 + q m from islands group by rid, q, island),
runs as materialized (select rid, s, m, min(q) q from stretches where m >= greatest(24, 3 * q) group by rid, s, m),
listed as (select rid, count(*) n_runs, string_agg(s || ',' || m || ',' || q || chr(10), '' order by s, q) lines from runs group by rid),
best as (select rid, s, m, q, row_number() over (partition by rid order by m::hugeint * 1000000000000 // q desc, s, q) r from runs),
gone as (select distinct rid, unnest(range(s + q, s + m)) i from runs),
kept as (select rid, string_agg(word, ' ' order by i) t from words anti join gone using (rid, i) group by rid)
select p.doc_id, coalesce(l.n_runs, 0)::bigint n_runs, b.s::bigint as start, b.m::bigint as length, b.q::bigint as period, (1000 * b.m // b.q)::bigint exponent_milli,
  sha256(coalesce(lines, '')) runs_sha256, sha256(coalesce(t, '')) collapsed_sha256
from planted p left join listed l using (rid) left join best b on b.rid = p.rid and b.r = 1 left join kept k on k.rid = p.rid
"""


def _secrets_sql() -> str:
    arms = []
    for rank, r in enumerate(secrets.BASE + secrets.MORE):
        pattern = "'" + r.java.replace("'", "''") + "'"
        arms.append(
            f"select rid, {rank} kind_rank, '{r.kind}' kind, {r.least} least, unnest(regexp_split_to_array(text, {pattern})) gap, unnest(regexp_extract_all(text, {pattern})) own,"
            f" unnest(regexp_extract_all(text, {pattern}, {r.group})) judged, unnest(range(1, len(regexp_split_to_array(text, {pattern})) + 1)) k from docs"
        )
    base = len(secrets.BASE)
    counts = ", ".join(f"count(*) filter (kind = '{r.kind}')::bigint n_{r.kind}" for r in secrets.BASE)
    return f"""
with docs as materialized (select row_number() over () rid, doc_id, coalesce(text, '') as text from documents),
found as ({" union all ".join(arms)}),
placed as (select *, sum(length(gap) + length(own)) over (partition by rid, kind_rank order by k) stop from found where own is not null),
spans as materialized (select rid, kind, kind_rank, stop - length(own) as start, kind || ':' || (stop - length(own))::bigint || ':' || stop::bigint span from placed where length(judged) >= least),
written as (
  select rid, {counts}, string_agg(span, ',' order by start, kind_rank) filter (kind_rank < {base}) base, string_agg(span, ',' order by start, kind_rank) spans from spans group by rid
)
select doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) n_{r.kind}" for r in secrets.BASE)}, sha256(coalesce(base, '')) base_sha256, coalesce(spans, '') spans
from docs left join written using (rid)
"""


ORACLE_SQL: dict[str, str] = {
    "op3_url_filters": _trust_sql(),
    "op5_jaccard_join": _JACCARD_SQL,
    "op6_suffix_dedup": _SUFFIX_SQL,
    "op8_nearest": _NEAREST_SQL,
    "op11_spelling": _SPELLING_SQL,
    "op12_periodic_runs": _PERIODIC_SQL,
    "op13_secrets": _secrets_sql(),
}
