"""Queries of the text operators (problems 1, 2, 4, 6, 8, 9 and 10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenar.llm.alignment import align_sentences
from lumenar.llm.boilerplate import content_lines, main_text
from lumenar.llm.lookalikes import canonical_column, same_reading_classes, same_reading_pairs
from lumenar.llm.mixing import mix_sources, reached_shares
from lumenar.llm.mojibake import garbled_documents, restore_documents
from lumenar.llm.spans import record_pairs, shared_report, shared_spans, without_repeats
from lumenar.llm.tokens import count_tokens, encode_column
from lumenar.session import cut_lineage, read_table


def _latest_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per post and translation; the latest delivery of a post counts."""
    posts = read_table(spark, sf_dir, "posts").groupBy("post_id").agg(F.max(F.struct("ingested_at", "content")).alias("last")).select("post_id", "last.content.*")
    return posts.select(F.col("post_id").alias("id"), F.expr("stack(2, 'spanish', spanish, 'portuguese', portuguese) as (lang, target)"), F.col("english").alias("source"))


def p1_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All links with their scores."""
    return align_sentences(_latest_contents(spark, sf_dir))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = p1_links(spark, sf_dir)
    return links.select(F.col("id").alias("post_id"), F.col("lang").alias("other_lang"), F.col("source_idx").alias("english_idx"), F.col("target_idx").alias("other_idx"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = read_table(spark, sf_dir, "posts")
    texts = posts.select(F.col("post_id").alias("id"), F.col("ingested_at").alias("version"), F.expr("stack(2, 'spanish', content.spanish, 'portuguese', content.portuguese) as (lang, text)"))
    pairs = same_reading_pairs(texts)
    return pairs.select(F.col("id_a").alias("post_a"), F.col("id_b").alias("post_b"), F.col("lang").alias("content_lang"))


def p2_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same without expanding copies: each text with its reading, where that has more than one spelling."""
    posts = read_table(spark, sf_dir, "posts")
    texts = posts.select(F.col("post_id").alias("id"), F.col("ingested_at").alias("version"), F.expr("stack(2, 'spanish', content.spanish, 'portuguese', content.portuguese) as (lang, text)"))
    found = same_reading_classes(texts)
    return found.select(F.col("id").alias("post_id"), F.col("lang").alias("content_lang"), F.lower(F.hex("reading")).alias("reading"), F.lower(F.hex("spelling")).alias("spelling"))


def p2_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every post's Spanish and Portuguese text in the consistent form; the latest delivery counts."""
    posts = read_table(spark, sf_dir, "posts").select("post_id", "ingested_at", F.col("content.spanish").alias("spanish"), F.col("content.portuguese").alias("portuguese"))
    latest = posts.groupBy("post_id").agg(F.max(F.struct("ingested_at", "spanish", "portuguese")).alias("last")).select("post_id", "last.spanish", "last.portuguese")
    return canonical_column(latest, ["spanish", "portuguese"]).drop("spanish", "portuguese")


_RUN_FIELDS = ["full_transcript", "plain_text"]


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = read_table(spark, sf_dir, "transcribe_runs")
    return runs.groupBy("run_id").agg(F.max(F.struct("ingested_at", *_RUN_FIELDS)).alias("last")).select("run_id", *[f"last.{f}" for f in _RUN_FIELDS])


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = record_pairs(_runs(spark, sf_dir), "run_id", _RUN_FIELDS)
    return pairs.select(F.col("rid_a").alias("run_a"), F.col("rid_b").alias("run_b"))


def p4_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each run is shared with other runs."""
    runs = _runs(spark, sf_dir)
    return shared_report(runs, shared_spans(runs, "run_id", _RUN_FIELDS), "run_id", _RUN_FIELDS)


def p4_without_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _runs(spark, sf_dir)
    return without_repeats(runs, shared_spans(runs, "run_id", _RUN_FIELDS), "run_id", _RUN_FIELDS)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = content_lines(read_table(spark, sf_dir, "page_captures"))
    return lines.select("page_id", F.explode(F.col("line_nos").cast("array<bigint>")).alias("line_no"))


def p6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(read_table(spark, sf_dir, "page_captures"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_column(read_table(spark, sf_dir, "documents"), keep=["doc_id"])


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_lineage(count_tokens(read_table(spark, sf_dir, "documents"), keep=["doc_id", "source"]))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many tokens as the targeted sources have; sources too small for their share are clamped at their cap."""
    return mix_sources(_sized(spark, sf_dir), read_table(spark, sf_dir, "mix_targets"))


def p9_mix_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many tokens as let every source with documents reach its share exactly."""
    return mix_sources(_sized(spark, sf_dir), read_table(spark, sf_dir, "mix_targets"), total="exact")


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares that ``p9_mix`` reaches."""
    sized, targets = _sized(spark, sf_dir), read_table(spark, sf_dir, "mix_targets")
    return reached_shares(mix_sources(sized, targets), sized, targets)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return garbled_documents(read_table(spark, sf_dir, "documents")).select("doc_id")


def p10_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return restore_documents(read_table(spark, sf_dir, "documents"))


QUERIES = {
    "p1_found": p1_found,
    "p1_links": p1_links,
    "p2_found": p2_found,
    "p2_classes": p2_classes,
    "p2_canonical": p2_canonical,
    "p4_found": p4_found,
    "p4_shared": p4_shared,
    "p4_without_repeats": p4_without_repeats,
    "p6_found": p6_found,
    "p6_main_text": p6_main_text,
    "p8_ids": p8_ids,
    "p9_mix": p9_mix,
    "p9_mix_exact": p9_mix_exact,
    "p9_shares": p9_shares,
    "p10_found": p10_found,
    "p10_restored": p10_restored,
}
# every window of the least length, written out: the shared ones make the pairs
_SPAN_PAIRS = """WITH t AS (SELECT DISTINCT run_id, txt FROM (SELECT run_id, full_transcript AS txt FROM transcribe_runs UNION ALL SELECT run_id, plain_text FROM transcribe_runs) WHERE length(txt) >= 200),
w AS (SELECT DISTINCT run_id, substr(txt, CAST(i AS INT), 200) AS s FROM (SELECT run_id, txt, unnest(range(1, length(txt) - 198)) AS i FROM t)),
m AS (SELECT s FROM w GROUP BY s HAVING count(*) > 1)
SELECT DISTINCT a.run_id AS run_a, b.run_id AS run_b FROM w a JOIN m ON a.s = m.s JOIN w b ON a.s = b.s WHERE a.run_id < b.run_id"""


# how much of each run lies in windows that another run holds too
_SPAN_SHARES = """WITH t AS (SELECT run_id, full_transcript, plain_text FROM transcribe_runs QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY ingested_at DESC NULLS LAST, full_transcript DESC NULLS LAST, plain_text DESC NULLS LAST) = 1),
f AS (SELECT run_id, 0 AS fld, full_transcript AS txt FROM t UNION ALL SELECT run_id, 1, plain_text FROM t),
w AS (SELECT run_id, fld, i, substr(txt, CAST(i AS INT), 200) AS s FROM (SELECT run_id, fld, txt, unnest(range(1, length(txt) - 198)) AS i FROM f WHERE length(txt) >= 200)),
m AS (SELECT s FROM w GROUP BY s HAVING min(run_id) < max(run_id)),
c AS (SELECT run_id, sum(least(200, coalesce(upto - i, 200))) AS shared FROM (SELECT run_id, i, lead(i) OVER (PARTITION BY run_id, fld ORDER BY i) AS upto FROM w JOIN m USING (s)) GROUP BY run_id),
n AS (SELECT run_id, CAST(coalesce(length(full_transcript), 0) + coalesce(length(plain_text), 0) AS BIGINT) AS n_chars FROM t)
SELECT run_id, n_chars, CAST(coalesce(shared, 0) AS BIGINT) AS shared_chars, CASE WHEN n_chars > 0 THEN coalesce(shared, 0) / n_chars ELSE 0.0 END AS shared_share FROM n LEFT JOIN c USING (run_id)"""


# Letters of other alphabets, each before the letter it looks like.
_ALIKE = (
    "аaеeоoрpсcуyхxіiѕsјjһhԁdԛqԝwАAВBЕEКKМMНHОOРPСCТTХXІIЅSЈJҮYԚQԜW"
    "οoνvϲcϳjΑAΒBΕEΖZΗHΙIΚKΜMΝNΟOΡPΤTΥYΧX"
    "ɑaɡgօoսuհhոn"
    "αaγyιiρpσoυuгrѡwӏiѴVѵvҽeЬbӀIԌGıi"
    "άáίíόóύúϊïϋüΆÁΈÉΊÍΌÓΎÝΫŸΪÏ"
    "‐-‑-"
)


def _canonical_sql(text: str) -> str:
    """Canonical form: characters mapped one to one, invisible ones removed (joined emoji stay), accents composed; enough for the signs of these texts."""
    table = dict(zip(_ALIKE[::2], _ALIKE[1::2]))
    table |= {chr(c + 0xFEE0): chr(c) for c in range(0x21, 0x7F)}
    table |= dict(zip("ⅰⅴⅹⅼⅽⅾⅿⅠⅤⅩⅬⅭⅮⅯ", "ivxlcdmIVXLCDM"))
    table |= dict.fromkeys("\xa0\u2002\u2003\u2005\u2007\u2009\u202f\u3000", " ") | {"ό": "ó"}
    quote = lambda x: x.replace("'", "''")
    given, made = quote("".join(table)), quote("".join(table.values()))
    emoji = r"[\x{2600}-\x{27bf}\x{1f000}-\x{1faff}]"
    joined = text
    for _ in range(2):  # a joiner's emoji may belong to the joiner before it
        joined = f"regexp_replace({joined}, '({emoji}\\x{{fe0f}}?)\\x{{200d}}({emoji})', '\\1' || chr(1) || '\\2', 'g')"
    bare = f"replace(regexp_replace({joined}, '[\\x{{ad}}\\x{{200b}}-\\x{{200d}}\\x{{2060}}\\x{{feff}}]', '', 'g'), chr(1), chr(8205))"
    return f"nfc_normalize(translate({bare}, '{given}', '{made}'))"


def _same_reading_sql() -> str:
    canon = _canonical_sql("t")
    parts = " UNION ".join(f"SELECT post_id, '{x}' AS content_lang, content.{x} AS t FROM posts WHERE trim(content.{x}) <> ''" for x in ("spanish", "portuguese"))
    return f"WITH c AS (SELECT post_id, content_lang, t, {canon} AS k FROM ({parts})) SELECT DISTINCT a.post_id AS post_a, b.post_id AS post_b, a.content_lang FROM c a JOIN c b ON a.k = b.k AND a.content_lang = b.content_lang WHERE a.post_id < b.post_id AND a.t <> b.t"


_CANONICAL_TEXTS = (
    f"WITH l AS (SELECT post_id, content.spanish AS spanish, content.portuguese AS portuguese FROM posts QUALIFY row_number() OVER (PARTITION BY post_id ORDER BY ingested_at DESC NULLS LAST, content.spanish DESC NULLS LAST, content.portuguese DESC NULLS LAST) = 1) "
    f"SELECT post_id, {_canonical_sql('spanish')} AS spanish_canonical, {_canonical_sql('portuguese')} AS portuguese_canonical FROM l"
)

ORACLES: dict[str, str] = {"p2_found": _same_reading_sql(), "p2_canonical": _CANONICAL_TEXTS, "p4_found": _SPAN_PAIRS, "p4_shared": _SPAN_SHARES}
