"""The registered queries of the pipeline operators, with production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from shortlist.llm import alignment, ann, chat, ngram_join, pii, quality, quality_net, spelling, url_filter, warc
from shortlist.llm.bpe_documents import encode_documents
from shortlist.llm.packing import pack_documents
from shortlist.llm.storage import new_folder
from shortlist.llm.token_files import read_documents, write_tokens


def _table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# Rules come before the list: the longest that fits decides.
RULES = [
    ("block", "net/"),
    ("allow", "example.net/en/"),
    ("block", "example.com/de/"),
    ("allow", "org/fr/"),
]


def op1_url_filter(spark, sf):
    """The list: canonical urls of the pages whose record is labelled toxic."""
    pages = _table(spark, sf, "pages")
    toxic = _table(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("page_id"))
    listed = pages.join(toxic, "page_id", "left_semi")
    listed = listed.select(url_filter.canonical_url(F.col("url")).alias("canonical"))
    judged = url_filter.filter_urls(pages, RULES, listed)
    return judged.select("page_id", "host", "path", "rule", "verdict", "canonical", "listed")


def op2_ann(spark, sf):
    vectors = _table(spark, sf, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op5_chat_views(spark, sf):
    views = chat.perspectives(_table(spark, sf, "conversations"))
    spans = F.array_join(F.transform("mask", lambda m: F.concat_ws(":", m["start"], m["end"])), ",")
    return views.select(
        "conv_id", "speaker", "part", "n_turns", F.md5("text").alias("text_md5"), spans.alias("mask"), "n_learnt"
    )


def op6_warc(spark, sf):
    folder = new_folder(spark, "warc")
    index = warc.write_bundles(warc.plan_records(_table(spark, sf, "pages")), folder)
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return warc.read_bundles(index, folder).select(*names)


def op3_token_files(spark, sf):
    folder = new_folder(spark, "tokens")
    parts = write_tokens(_table(spark, sf, "documents"), folder, _vocabulary("byte_bpe_50k.json"), end_id=0)
    return read_documents(parts, folder)


def op4_bpe(spark, sf):
    coded = encode_documents(_table(spark, sf, "documents"), _vocabulary("word_bpe_49k.json"))
    return coded.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


def op7_pii(spark, sf):
    docs = _table(spark, sf, "documents").select("doc_id", "text")
    found = docs.select("doc_id", pii.personal_data(F.col("text"), pii.fit(docs))["spans"].alias("spans"))
    base = F.filter("spans", lambda s: s["base"])

    def count(kind):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *map(count, pii.KINDS), F.sha2(pii.span_text(base), 256).alias("base_sha256"), pii.span_text(F.col("spans")).alias("spans")
    )


def op8_quality(spark, sf):
    docs = _table(spark, sf, "documents").select("doc_id", "lang", "text")
    measured = quality.store(quality.with_measures(docs, ["lang"]).drop("text"))
    judged = quality.judge(measured, *quality.fit_cutoffs(measured, _table(spark, sf, "labels")))
    return judged.select(
        "doc_id",
        *(f"quality_measures.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
        "base_failed",
        "kept",
    )


def op9_ngram_join(spark, sf):
    return ngram_join.near_duplicates(_table(spark, sf, "documents"))


def op10_packing(spark, sf):
    return pack_documents(_table(spark, sf, "documents"), _vocabulary("word_bpe_49k.json"), end_id=2).drop("ids")


def op11_spelling(spark, sf):
    return spelling.variants(_table(spark, sf, "documents"))


def op12_quality_net(spark, sf):
    return quality_net.score_documents(_table(spark, sf, "documents"), _table(spark, sf, "labels"))


def op13_alignment(spark, sf):
    paths = _vocabulary("byte_bpe_50k.json"), _vocabulary("piece_bpe_32k.model")
    aligned = alignment.align(_table(spark, sf, "documents"), *paths, with_groups=False)
    rows = alignment.with_link_counts(aligned, len(alignment.Sizes.of(*paths).b))
    return rows.drop("row").withColumnRenamed("groups", "groups_sha256")


QUERIES = {f.__name__: f for f in (op1_url_filter, op2_ann, op5_chat_views, op6_warc, op3_token_files, op4_bpe, op7_pii, op8_quality, op9_ngram_join, op10_packing, op11_spelling, op12_quality_net, op13_alignment)}

_HOST = "translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_OP1 = f"""
WITH cut AS (
  SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages
), parts AS (
  SELECT page_id, coalesce({_HOST}, '') AS host,
    coalesce(substr(regexp_extract(rest, '^([^?#]*)', 1), length(regexp_extract(rest, '^([^/?#]*)', 1)) + 1), '') AS path,
    list_sort(list_filter(string_split(regexp_extract(rest, '^[^?#]*[?]([^#]*)', 1), '&'),
      lambda p: p <> '' AND NOT starts_with(p, 'utm_'))) AS params
  FROM cut
), canon AS (
  SELECT page_id, host, path, CASE WHEN host <> '' THEN concat(regexp_replace(host, '^www[.]', ''),
    regexp_replace(path, '/+$', ''), CASE WHEN len(params) > 0 THEN concat('?', array_to_string(params, '&')) ELSE '' END)
    END AS canonical
  FROM parts
), judged AS (
  SELECT *, CASE
      WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
      WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
      WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
      WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/'
    END AS rule
  FROM canon
), listed AS (
  SELECT DISTINCT canonical FROM canon WHERE canonical IS NOT NULL
    AND page_id IN (SELECT doc_id FROM labels WHERE toxic = 1)
)
SELECT page_id, host, path, canonical, rule, rule IS NULL AND l.canonical IS NOT NULL AS listed,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
    WHEN l.canonical IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM judged LEFT JOIN listed l USING (canonical)
"""

_OP5 = """
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS place FROM turns
), speakers AS (
  SELECT DISTINCT conv_id AS of, role AS speaker FROM turns WHERE role <> 'system'
), pieces AS (
  SELECT conv_id, speaker, place // 256 AS part, place, role = speaker AS mine,
    CASE WHEN role = speaker THEN '<|im_start|>assistant' || chr(10)
      WHEN role = 'system' THEN '<|im_start|>system' || chr(10)
      ELSE '<|im_start|>user name=' || replace(role, '<|', '< |') || chr(10) END AS head,
    replace(text, '<|', '< |') || '<|im_end|>' || chr(10) AS body
  FROM placed JOIN speakers ON conv_id IS NOT DISTINCT FROM of
), spots AS (
  SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, speaker, part ORDER BY place) AS stop FROM pieces
)
SELECT conv_id, speaker, CAST(part AS INTEGER) AS part, CAST(count(*) AS INTEGER) AS n_turns,
  md5(string_agg(head || body, '' ORDER BY place)) AS text_md5,
  coalesce(string_agg((stop - length(body)) || ':' || stop, ',' ORDER BY place) FILTER (WHERE mine), '') AS mask,
  CAST(coalesce(sum(length(body)) FILTER (WHERE mine), 0) AS INTEGER) AS n_learnt
FROM spots GROUP BY conv_id, speaker, part
"""

_OP6 = """
WITH held AS (
  SELECT page_id, coalesce(html, '') AS html, CAST(CAST(unhex(sha1(coalesce(html, ''))) AS BIT) AS VARCHAR) AS bits
  FROM pages
), firsts AS (
  SELECT html, min(page_id) AS first FROM held GROUP BY html
)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1
    + 16 * CAST(substr(bits, 5 * i + 1, 1) AS INT) + 8 * CAST(substr(bits, 5 * i + 2, 1) AS INT)
    + 4 * CAST(substr(bits, 5 * i + 3, 1) AS INT) + 2 * CAST(substr(bits, 5 * i + 4, 1) AS INT)
    + CAST(substr(bits, 5 * i + 5, 1) AS INT) AS INT), 1)), '') AS payload_digest,
  CASE WHEN page_id IS DISTINCT FROM first AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM held JOIN firsts USING (html)
"""

ORACLES = {"op1_url_filter": _OP1, "op5_chat_views": _OP5, "op6_warc": _OP6}
