"""One registered query for each operator, over whole tables, and SQL twins where SQL can."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import decontaminate, jaccard_join, language, lexical_search, line_templates, packing, pii, pivot_index, shard_ring, sql_twins, suffix_dedup, url_filter, vector_codes, wavelet
from .common import table

_START = "timestamp'2024-01-01 00:00:00'"


def dated_entries(pages):
    """A dated list that grows with the pages: turns of each host's block and allow entries.

    A host's first page decides which entries it gets and when. Blocks of hosts are lifted
    and set again, some sites are blocked with their subdomains, and some sections of a
    host are allowed for a time.
    """
    host, segments = url_filter.parsed(F.col("url"))
    hosts = pages.where("page_id IS NOT NULL").select(
        "page_id", host.alias("host"), segments[0].alias("section")).where("host IS NOT NULL")
    first = hosts.groupBy("host").agg(
        F.min("page_id").alias("m"), F.min_by("section", "page_id").alias("section"))
    site = F.array_join(F.slice(F.split("host", r"\."), -3, 3), ".")
    entry = lambda when, what, kind, value, action, day: F.when(when, F.struct(
        F.lit(what).alias("list"), F.lit(kind).alias("kind"), value.alias("value"),
        F.lit(action).alias("action"),
        (F.expr(_START) + F.make_dt_interval(day)).alias("at")))
    m, host = F.col("m"), F.col("host")
    deep = F.size(F.split("host", r"\.")) >= 3
    day = lambda factor, span, plus=0: (m * factor % span + plus).cast("int")
    section = F.concat("host", F.lit("/"), "section")
    turns = F.array(
        entry(m % 3 == 0, "block", "host", host, "add", day(7, 200)),
        entry(m % 3 == 0, "block", "host", host, "remove", day(7, 200, 60)),
        entry(m % 3 == 0, "block", "host", host, "add", day(7, 200, 150)),
        entry((m % 5 == 1) & deep, "block", "domain", site, "add", day(11, 300)),
        entry(m % 4 == 0, "allow", "prefix", section, "add", day(3, 100)),
        entry(m % 4 == 0, "allow", "prefix", section, "remove", day(3, 100, 200)))
    return first.select(F.explode(F.filter(turns, lambda t: t.isNotNull())).alias("t")).select("t.*")


def op1(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched_at", F.expr(
        f"{_START} + make_dt_interval(cast(page_id * 13 % 365 as int), "
        "cast(page_id % 24 as int))"))
    return url_filter.judge(captures, dated_entries(pages))


OP1_SQL = r"""
WITH bare AS (
  SELECT page_id, url, regexp_replace(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS b,
         TIMESTAMP '2024-01-01' + to_days(CAST(page_id * 13 % 365 AS INTEGER))
           + to_hours(page_id % 24) AS fetched_at FROM pages),
parsed AS (
  SELECT page_id, url, fetched_at,
         nullif(lower(regexp_replace(regexp_replace(regexp_extract(b, '^([^/?#]*)', 1),
           '^.*@', ''), '\.?(:[0-9]*)?$', '')), '') AS host,
         string_split(regexp_replace(regexp_extract(b, '^[^/?#]*/?([^?#]*)', 1), '/+$', ''), '/')
           AS segs FROM bare),
firsts AS (
  SELECT host, min(page_id) AS m, arg_min(segs[1], page_id) AS section FROM parsed
  WHERE page_id IS NOT NULL AND host IS NOT NULL GROUP BY host),
shaped AS (
  SELECT *, host || '/' || section AS prefix, string_split(host, '.') AS labels FROM firsts),
entries AS (
  SELECT 'block' AS list, 'host' AS kind, host AS value, true AS op, m * 7 % 200 AS day FROM shaped WHERE m % 3 = 0
  UNION ALL SELECT 'block', 'host', host, false, m * 7 % 200 + 60 FROM shaped WHERE m % 3 = 0
  UNION ALL SELECT 'block', 'host', host, true, m * 7 % 200 + 150 FROM shaped WHERE m % 3 = 0
  UNION ALL SELECT 'block', 'domain', array_to_string(labels[-3:], '.'), true, m * 11 % 300
    FROM shaped WHERE m % 5 = 1 AND len(labels) >= 3
  UNION ALL SELECT 'allow', 'prefix', prefix, true, m * 3 % 100 FROM shaped WHERE m % 4 = 0
  UNION ALL SELECT 'allow', 'prefix', prefix, false, m * 3 % 100 + 200 FROM shaped WHERE m % 4 = 0),
changes AS (
  SELECT list, kind, value, TIMESTAMP '2024-01-01' + to_days(CAST(day AS INTEGER)) AS t, bool_and(op) AS act
  FROM entries GROUP BY ALL),
turns AS (
  SELECT *, lag(act, 1, false) OVER (PARTITION BY list, kind, value ORDER BY t) AS was FROM changes),
spans AS (
  SELECT *, lead(t) OVER (PARTITION BY list, kind, value ORDER BY t) AS until
  FROM turns WHERE act <> was),
keys AS (
  SELECT DISTINCT url, fetched_at, unnest(list_concat(
    list_transform(range(1, len(string_split(host, '.')) + 1),
      lambda i: {'kind': 'domain', 'value': array_to_string(string_split(host, '.')[i:], '.')}),
    [{'kind': 'host', 'value': host}],
    list_transform(range(1, len(segs) + 1),
      lambda i: {'kind': 'prefix', 'value': host || '/' || array_to_string(segs[1:i], '/')}))) AS key
  FROM parsed WHERE host IS NOT NULL AND fetched_at IS NOT NULL),
hits AS (
  SELECT url, fetched_at, count(*) FILTER (WHERE list = 'block') AS n_block,
         count(*) FILTER (WHERE list = 'allow') AS n_allow,
         min(CASE WHEN list = 'block' THEN kind || ':' || value END) AS block_entry
  FROM keys JOIN spans ON key.kind = spans.kind AND key.value = spans.value
   AND act AND fetched_at >= t AND (until IS NULL OR fetched_at < until)
  GROUP BY url, fetched_at)
SELECT p.page_id, p.url, p.fetched_at, coalesce(n_block, 0) AS n_block,
       coalesce(n_allow, 0) AS n_allow, block_entry,
       coalesce(n_block, 0) = 0 OR coalesce(n_allow, 0) > 0 AS allowed
FROM parsed p LEFT JOIN hits h ON p.url = h.url AND p.fetched_at = h.fetched_at
"""


def op2(spark, sf_dir):
    placed = shard_ring.shard_documents(table(spark, sf_dir, "documents"), 24)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "home_shard")


def _vocabulary(name):
    import public_tokenizers

    return public_tokenizers.path(name)


def op3(spark, sf_dir):
    return line_templates.drop_recurring_lines(table(spark, sf_dir, "documents"))


_LEVEL = r"""
top{k} AS (
  SELECT node, max({{'docs': docs, 'masked': masked}}) AS top, sum(docs) AS seen FROM at{k} GROUP BY node),
far{k} AS (
  SELECT a.node, a.masked, a.docs, len(string_split(a.masked, ' ')) AS n,
         list_filter(range(1, len(string_split(a.masked, ' ')) + 1), lambda i:
           string_split(a.masked, ' ')[i] <> string_split(t.top.masked, ' ')[i]) AS off
  FROM at{k} a JOIN top{k} t ON a.node = t.node AND t.seen >= 5),
fit{k} AS (
  SELECT masked, node AS template FROM far{k} WHERE len(off) <= floor(0.2 * greatest(n - 5, 0) + 1e-9)),
at{next} AS (
  SELECT list_append(node, CAST(off[1] AS VARCHAR) || ' ' || string_split(masked, ' ')[off[1]]) AS node,
         masked, docs FROM far{k} WHERE len(off) > floor(0.2 * greatest(n - 5, 0) + 1e-9)),"""

OP3_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS line_no,
         unnest(string_split(text, chr(10))) AS line FROM documents),
tokens AS (
  SELECT doc_id, line_no, trim(regexp_replace(regexp_replace(line,
    '[^\x09-\x0D\x20]*[0-9][^\x09-\x0D\x20]*', '<*>', 'g'), '[\x09-\x0D\x20]+', ' ', 'g')) AS masked
  FROM lines),
placed AS (
  SELECT *, list_concat([CAST(len(string_split(masked, ' ')) AS VARCHAR)],
                        string_split(masked, ' ')[1:5]) AS node FROM tokens WHERE masked <> ''),
at0 AS (
  SELECT node, masked, count(DISTINCT doc_id) AS docs FROM placed
  WHERE node IN (SELECT node FROM placed GROUP BY node HAVING count(DISTINCT doc_id) >= 5)
  GROUP BY node, masked),
""" + "".join(_LEVEL.format(k=k, next=k + 1) for k in range(3)) + """
templates AS (
  SELECT * FROM fit0 UNION ALL SELECT * FROM fit1 UNION ALL SELECT * FROM fit2
  UNION ALL SELECT masked, list_append(node, masked) FROM at3),
instances AS (
  SELECT p.doc_id, p.line_no, t.template FROM placed p JOIN templates t USING (masked)),
recurring AS (
  SELECT template, min({'d': doc_id, 'l': line_no}) AS first FROM instances
  GROUP BY template HAVING count(DISTINCT doc_id) >= 5),
gone AS (
  SELECT doc_id, line_no FROM instances JOIN recurring USING (template)
  WHERE doc_id <> first.d OR line_no <> first.l)
SELECT l.doc_id, count(*) AS n_lines, count(g.line_no) AS n_dropped,
       coalesce(string_agg(CASE WHEN g.line_no IS NULL THEN line END, chr(10) ORDER BY l.line_no), '') AS text
FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.line_no = g.line_no GROUP BY l.doc_id
"""


def op4(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "text", "lang", language.held_out(F.col("doc_id")).alias("held_out"))
    return language.identify(docs, keep=("doc_id", "held_out")).select(
        "row.doc_id", "row.held_out", "lang_pred", "score", "rejected")


def op5(spark, sf_dir):
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


def op6(spark, sf_dir):
    path = wavelet.write_index(table(spark, sf_dir, "documents"),
                               _vocabulary("word_bpe_49k.json"), end_id=2)
    return wavelet.documents_of(spark, path)


def op7(spark, sf_dir):
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op8(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"),
                                  _vocabulary("byte_bpe_50k.json"), 1024, end_id=2)


def op9(spark, sf_dir):
    return decontaminate.leaks(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10(spark, sf_dir):
    return pivot_index.near_vectors(table(spark, sf_dir, "embeddings"))


def op11(spark, sf_dir):
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


def op12(spark, sf_dir):
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13(spark, sf_dir):
    spans = F.col("spans")
    return pii.find_pii(table(spark, sf_dir, "documents")).select(
        "doc_id", *[pii.counted(spans, k).alias(f"n_{k}") for k in pii.BASE],
        F.sha2(pii.digest(pii.base_only(spans)), 256).alias("base_sha256"),
        pii.digest(spans).alias("spans"))


QUERIES = {
    "op1_url_filter": (op1, OP1_SQL),
    "op2_shard_ring": (op2, None),
    "op3_line_templates": (op3, OP3_SQL),
    "op4_language": (op4, None),
    "op5_jaccard_join": (op5, None),
    "op6_wavelet_index": (op6, None),
    "op7_suffix_dedup": (op7, None),
    "op8_best_fit_pack": (op8, None),
    "op9_decontaminate": (op9, None),
    "op10_pivot_index": (op10, None),
    "op11_vector_codes": (op11, sql_twins.OP11_SQL),
    "op12_lexical_search": (op12, sql_twins.OP12_SQL),
    "op13_pii": (op13, sql_twins.OP13_SQL),
}
