"""Queries that apply each operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from visitline.llm import alignment, chains, chat, decontaminate, exact, html, jaccard, langid, mixing, phrases, ppm, secrets, toxicity
from visitline.session import materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return keep


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def held_out(modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves this remainder; a null id is never held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder, F.lit(False))


@query("op1_main_text")
def main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet")).drop("n_templates")


@query("op2_toxicity")
def toxic_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out(5, 0))
    model = toxicity.fit_toxicity(docs.where(~held_out(5, 0)), labels)
    return toxicity.score_toxicity(docs, model, held_out=held_out(5, 0))


@query("op3_decontaminate")
def contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@query("op4_ppm_score")
def ppm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = ppm.score_texts(docs, ~held_out(10, 0))
    return scored.select("doc_id", (~F.col("trained")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op5_language_codes")
def language_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = langid.fit_language_codes(docs.where(~held_out(3, 1)).select("doc_id", "text", "lang"))
    return langid.predict_language(docs, model, keep=["doc_id", held_out(3, 1).alias("held_out")])


_EXACT_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS x FROM documents),
g AS (SELECT x, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY x)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(x) AS text_sha256 FROM t JOIN g USING (x)
"""


@query("op6_exact_dedup", _EXACT_SQL)
def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(documents(spark, sf_dir)).drop("n_chunks")


@query("op7_ngram_jaccard")
def ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(documents(spark, sf_dir), words_per_shingle=3, similarity=(90, 100))


MIX_WEIGHTS = {"domain": {"web": 5, "books": 2, "code": 1}, "lang": {"en": 4, "de": 2, "fr": 2, "es": 1}, "source": {"src0": 3}}
MIX_EPOCHS = 2


def source_domain(source: Column) -> Column:
    """Domain of a source by its number: the first half are web, then books, then code."""
    number = F.regexp_extract(source, r"(\d+)$", 1).try_cast("int")
    return F.when(number < 10, "web").when(number < 16, "books").when(number.isNotNull(), "code").otherwise("other")


def _share_sql(level: str, up: str, source: str, parents: str | None, weights: dict[str, int]) -> str:
    case = "CASE " + " ".join(f"WHEN {level} = '{k}' THEN {w}" for k, w in weights.items()) + " ELSE 1 END"
    part = f"PARTITION BY {up} " if up else ""
    cols = f"{up}, {level}" if up else level
    base = f"SELECT {cols}, sum(supply)::HUGEINT AS supply, ({case})::HUGEINT AS weight FROM {source} GROUP BY ALL"
    budget = f"SELECT b.*, p.budget AS b FROM ({base}) b JOIN {parents} p USING ({up})" if parents else f"SELECT b.*, (SELECT sum(supply) // {MIX_EPOCHS} // 2 FROM leaves)::HUGEINT AS b FROM ({base}) b"
    return f"""
    SELECT {cols}, CASE WHEN lw IS NULL OR (r, {level}) < (lr, lk) THEN supply ELSE least(supply, greatest(ll, 0) * weight // lw) END AS budget FROM (
      SELECT *, first_value(CASE WHEN bad THEN lft END IGNORE NULLS) OVER w2 AS ll, first_value(CASE WHEN bad THEN rem END IGNORE NULLS) OVER w2 AS lw,
        first_value(CASE WHEN bad THEN r END IGNORE NULLS) OVER w2 AS lr, first_value(CASE WHEN bad THEN {level} END IGNORE NULLS) OVER w2 AS lk FROM (
        SELECT *, supply * rem > greatest(lft, 0) * weight AS bad FROM (
          SELECT *, supply::DOUBLE / weight::DOUBLE AS r, b - coalesce(sum(supply) OVER w1, 0) AS lft,
            sum(weight) OVER ({part}) - coalesce(sum(weight) OVER w1, 0) AS rem FROM ({budget})
          WINDOW w1 AS ({part}ORDER BY supply::DOUBLE / weight::DOUBLE, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)))
      WINDOW w2 AS ({part}ORDER BY r, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"""


_MIX_SQL = rf"""
WITH t AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, try_cast(regexp_extract(source, '(\d+)$', 1) AS INTEGER) AS number,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_tokens FROM documents),
tokens AS (SELECT doc_id, CASE WHEN number < 10 THEN 'web' WHEN number < 16 THEN 'books' WHEN number IS NOT NULL THEN 'code' ELSE 'other' END AS domain,
  lang, source, n_tokens FROM t WHERE n_tokens > 0),
sizes AS (SELECT domain, lang, source, sum(n_tokens)::HUGEINT AS leaf_tokens FROM tokens GROUP BY ALL),
leaves AS (SELECT domain, lang, source, leaf_tokens * {MIX_EPOCHS} AS supply FROM sizes),
d AS ({_share_sql("domain", "", "leaves", None, MIX_WEIGHTS["domain"])}),
l AS ({_share_sql("lang", "domain", "leaves", "d", MIX_WEIGHTS["lang"])}),
s AS ({_share_sql("source", "domain, lang", "leaves", "l", MIX_WEIGHTS["source"])}),
r AS (SELECT tokens.*, s.budget, s.budget // leaf_tokens AS whole, s.budget - (s.budget // leaf_tokens) * leaf_tokens AS rest
  FROM tokens JOIN s USING (domain, lang, source) JOIN sizes USING (domain, lang, source)),
o AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source
    ORDER BY md5('17:' || (whole + 1)::VARCHAR || ':' || doc_id::VARCHAR), doc_id, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r)
SELECT doc_id, e.epoch::INTEGER AS epoch, domain, lang, source, n_tokens::BIGINT AS n_tokens, budget::BIGINT AS leaf_budget
FROM o JOIN (SELECT unnest(range(1, {MIX_EPOCHS + 1})) AS epoch) e ON e.epoch <= whole
UNION ALL SELECT doc_id, (whole + 1)::INTEGER, domain, lang, source, n_tokens::BIGINT, budget::BIGINT FROM o WHERE before < rest
"""


@query("op8_mix_sources", _MIX_SQL)
def mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return mixing.mix_sources(docs, source_domain(F.col("source")), weights=MIX_WEIGHTS, epochs=MIX_EPOCHS)


@query("op10_secret_scan")
def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(documents(spark, sf_dir))


@query("op9_repeated_passages")
def repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chains.repeated_passages(documents(spark, sf_dir))


CHAT_BUDGET, CHAT_HISTORY = 1024, 128
_CHAT_SQL = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, unnest([0, 1]), unnest(['user', 'assistant']), '\### Assistant: </turn> ok'),
u AS (
  SELECT *, greatest(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), (length(text) + 3) // 4) + 4 AS tokens,
    15 + length(replace(replace(replace(role, '%', '%25'), '<', '%3C'), chr(10), '%0A')) + length(regexp_replace(text, '<(\\*)(/?turn)', '<\\\1\2', 'g')) AS chars,
    row_number() OVER w AS pos, first_value(role) OVER w = 'system' AS has_system
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
v AS (
  SELECT *, has_system AND pos = 1 AS sys, max(CASE WHEN has_system AND pos = 1 THEN tokens ELSE 0 END) OVER (PARTITION BY conv_id) AS sys_tokens,
    max(CASE WHEN has_system AND pos = 1 THEN chars ELSE 0 END) OVER (PARTITION BY conv_id) AS sys_chars,
    sum(tokens) OVER (PARTITION BY conv_id ORDER BY pos) AS upto FROM u),
p AS (SELECT *, upto - sys_tokens AS fin, upto - sys_tokens - tokens AS st, greatest({CHAT_BUDGET - CHAT_HISTORY} - sys_tokens, {CHAT_BUDGET // 4}) AS room FROM v),
c AS (SELECT *, CASE WHEN sys THEN 0 ELSE st // (room - room // 4) END AS cell FROM p),
k AS (SELECT *, NOT sys AND fin > (cell + 1) * (room - room // 4) AND count(*) FILTER (NOT sys) OVER cells > 1
    AND max(fin) OVER cells - min(st) FILTER (NOT sys) OVER cells > room AS alone FROM c WINDOW cells AS (PARTITION BY conv_id, cell)),
w AS (SELECT conv_id, cell, alone, min(st) FILTER (NOT sys) AS begins, sum(chars) AS chars, max(CASE WHEN sys THEN 0 ELSE sys_chars END) AS sys_chars, bool_or(sys) AS has_own FROM k GROUP BY ALL),
h AS (SELECT w.conv_id, sum(k.chars) AS chars FROM w JOIN k ON w.conv_id = k.conv_id AND NOT k.sys AND k.st < w.begins AND k.st >= w.begins - {CHAT_HISTORY} GROUP BY ALL),
f AS (SELECT conv_id, sum(chars) + sum(CASE WHEN has_own THEN 0 ELSE sys_chars END) AS chars FROM w GROUP BY ALL)
SELECT k.conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (any_value(f.chars) + coalesce(any_value(h.chars), 0))::BIGINT AS formatted_chars
FROM k JOIN f USING (conv_id) LEFT JOIN h USING (conv_id) GROUP BY k.conv_id
"""


@query("op13_chat_windows", _CHAT_SQL)
def chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of what the windows hold; a digest needs a conversation's texts in one cell, the windows don't."""
    odd = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(r"\### Assistant: </turn> ok").alias("text"),
    )
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").union(odd)
    windows = chat.chat_windows(turns, budget=CHAT_BUDGET, history=CHAT_HISTORY)
    said = chat.read_windows(windows.withColumn("window", F.struct("window", F.length("formatted").alias("chars"))))
    joined = lambda texts: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("window", texts))), lambda x: x["said"]), "")
    turns_text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    whole = said.groupBy("conv_id").agg(
        F.sum(F.size("turns")).alias("n_turns"), joined(turns_text.alias("said")).alias("turns"),
        joined(F.array_join("learned", "").alias("said")).alias("learned"), F.sum("window.chars").alias("formatted_chars"),
    )
    return whole.select(
        "conv_id", "n_turns", F.sha2(F.col("turns").cast("binary"), 256).alias("turns_sha256"), F.length("learned").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"), "formatted_chars",
    )


PHRASE_LEAST, PHRASE_TOP = 30, 2000
_PHRASE_SQL = rf"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (
    SELECT lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (
    SELECT lang, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM p, (VALUES (1), (2), (3), (4)) AS s(k) WHERE len(w) >= k)),
f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= {PHRASE_LEAST}),
c AS (SELECT f.*, string_split(phrase, ' ') AS w, unnest(generate_series(1, k - 1)) AS cut FROM f WHERE k > 1),
s AS (SELECT c.lang, c.phrase, c.k, c.a, c.cut, x.a AS l, y.a AS r, (2000000::HUGEINT * c.a) // (x.a + y.a) AS score FROM c
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.cut], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.cut + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inner_parts AS (SELECT DISTINCT lang, array_to_string(w[i:i + m - 1], ' ') AS part, a FROM (
    SELECT lang, w, a, m, unnest(generate_series(1, k - m + 1)) AS i FROM (SELECT DISTINCT lang, k, w, a FROM c), (VALUES (2), (3)) AS s(m) WHERE m < k)),
d AS (SELECT b.* FROM b WHERE NOT EXISTS (SELECT 1 FROM inner_parts i WHERE i.lang = b.lang AND i.part = b.phrase AND 100 * i.a >= 80 * b.a))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM d JOIN n USING (lang) QUALIFY rank <= {PHRASE_TOP}
"""


@query("op12_phrases", _PHRASE_SQL)
def best_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.best_phrases(phrases.collocations(documents(spark, sf_dir), least=PHRASE_LEAST), PHRASE_TOP)


TOKENIZERS = "/opt/tokenizers"


@query("op11_token_alignment")
def token_alignment(spark: SparkSession, sf_dir: str, folder: str = TOKENIZERS) -> DataFrame:
    first, second = f"{folder}/byte_bpe_50k.json", f"{folder}/piece_bpe_32k.model"
    aligned = alignment.align_tokens(documents(spark, sf_dir), first, second)
    digest = F.when(F.col("n_a") > 0, F.sha2(F.col("groups").cast("binary"), 256)).otherwise(F.lit(""))
    written = materialize(aligned.withColumn("groups_sha256", digest).drop("groups"), "aligned")
    scored = alignment.score_links(written, alignment.piece_count(second))
    return scored.select(*[c for c in scored.columns if c != "groups_sha256"], "groups_sha256")
