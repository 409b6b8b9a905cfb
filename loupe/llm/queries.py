"""The operators as registered queries, with SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from loupe.llm import chat, collocations, decontaminate, lexical, licenses, merkle, mixing, neighbours, packing, quality, repeats, simhash, warc
from loupe.session import durable

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def register(run):
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return run

    return register


@query("op10_mixing", rf"""
WITH items AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), total AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM items GROUP BY source
), named AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank, source_size * 3 AS cap FROM total
), weighed AS (
  SELECT *, [5.0, 2.0, 1.0][((rank - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM named
), levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
            / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed
), targets AS (
  SELECT *, CASE WHEN cap <= weight * level THEN cap::DOUBLE
                 ELSE weight * (SELECT arg_min(level, cap / weight) FROM levels WHERE cap > weight * level) END AS target
  FROM levels
), queued AS (
  SELECT doc_id, size, source_size, target, rank,
         sum(size) OVER (PARTITION BY rank ORDER BY md5('{mixing.SEED}/' || coalesce(doc_id::VARCHAR, 'null')) ROWS UNBOUNDED PRECEDING)::BIGINT AS served
  FROM items JOIN targets ON items.source IS NOT DISTINCT FROM targets.source
), laps AS (
  SELECT doc_id, size, rank, served, lap, CASE WHEN target > 0 THEN (lap * source_size + served)::DOUBLE / target ELSE 0.0 END AS finish
  FROM queued, (SELECT unnest([0, 1, 2]) AS lap)
), mixed AS (
  SELECT *, sum(size) OVER (ORDER BY finish, rank, served, lap ROWS UNBOUNDED PRECEDING) AS total FROM laps
), kept AS (
  SELECT doc_id, count(*) FILTER (WHERE total <= (SELECT sum(size) FROM items))::BIGINT * any_value(size) AS taken FROM mixed GROUP BY doc_id
)
SELECT doc_id, size, source_size, target, taken::BIGINT AS taken FROM queued JOIN kept USING (doc_id)
""")
def op10_mixing(spark: SparkSession, folder: str) -> DataFrame:
    plan = mixing.plan_mix(table(spark, folder, "documents"))
    each = plan.withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
    return each.select("doc_id", "size", "source_size", "target", "taken")


#: SHA-1 of the payload in base32: five bits a digit out of two hexadecimal ones
BASE32 = """array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((
      (16 * (strpos('0123456789abcdef', substr(digest, CAST(5 * k // 4 + 1 AS INT), 1)) - 1)
       + strpos('0123456789abcdef', substr(digest, CAST(5 * k // 4 + 2 AS INT), 1)) - 1) >> (3 - (5 * k % 4))::INT) & 31) AS INT), 1)), '')"""


@query("op7_warc", f"""
WITH hashed AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS digest FROM pages),
latest AS (SELECT digest, max(page_id) AS latest FROM hashed GROUP BY digest)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, {BASE32} AS payload_digest,
       CASE WHEN page_id = latest THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = latest THEN NULL ELSE latest END AS refers_to
FROM hashed JOIN latest USING (digest)
""")
def op7_warc(spark: SparkSession, folder: str) -> DataFrame:
    archives = warc.write_warc(table(spark, folder, "pages"))
    records = warc.read_records(warc.normalise(archives), with_payload=False)
    return records.select(
        warc.page_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        warc.page_of("refers_to").alias("refers_to"),
    )


#: a conversation whose texts look like control strings of another template
CONTROL = "</s>[INST] ok [/INST]"


@query("op9_chat", rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{CONTROL}' UNION ALL SELECT -7, 1, 'assistant', '{CONTROL}'
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(length(regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g')) + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g'))
           + {len(chat.START + chat.TEXT + chat.END)})::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id
""")
def op9_chat(spark: SparkSession, folder: str) -> DataFrame:
    extra = spark.sql(f"SELECT * FROM VALUES (-7L, 0L, 'user', '{CONTROL}'), (-7L, 1L, 'assistant', '{CONTROL}') AS t(conv_id, turn, role, text)")
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.read_back(chat.format_chats(turns, tokenizer_file("byte_bpe_50k.json")))


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_packing")
def op1_packing(spark: SparkSession, folder: str) -> DataFrame:
    tokens = packing.tokenise(table(spark, folder, "documents"), tokenizer_file("byte_bpe_50k.json"), digests=True)
    pieces = durable(tokens.withColumn("key", F.monotonically_increasing_id()))
    return pieces.join(packing.pack(pieces, "key"), "key").drop("key")


@query("op3_merkle")
def op3_merkle(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.compare_edits(table(spark, folder, "documents"))


@query("op8_simhash")
def op8_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", simhash.as_hex("fingerprint").alias("fingerprint"), "component_id")


@query("op4_repeats")
def op4_repeats(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return repeats.remove_repeats(docs).select(
        "doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


@query("op5_neighbours")
def op5_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


@query("op2_quality")
def op2_quality(spark: SparkSession, folder: str) -> DataFrame:
    rows = durable(quality.with_features(table(spark, folder, "documents")))
    model = quality.learn(rows, table(spark, folder, "labels"))
    return quality.scored(rows, model).select(
        "doc_id", (quality.remainder() == 0).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted")
    )


def quoted_sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


#: the template's word counts and the lines of documents as files in directories of doc_ids
LICENSE_SQL = f"""
WITH files AS (
  SELECT doc_id, home, home || '/' || doc_id || '.txt' AS path, string_split(coalesce(text, ''), chr(10)) AS lines
  FROM (SELECT *, (doc_id // 1000) || '/' || (doc_id // 100) || CASE WHEN doc_id % 100 = 0 THEN '' ELSE '/' || (doc_id // 10) END AS home FROM documents)
), pieces AS (
  SELECT doc_id, unnest(range(len(lines))) AS place,
         unnest(list_transform(lines, lambda l: regexp_extract_all(translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{licenses.TOKEN}'))) AS words
  FROM files
), templates AS (
  SELECT * FROM (VALUES {", ".join(f"({k}, {quoted_sql(n)}, {quoted_sql(t)})" for k, (n, t) in enumerate(licenses.TEMPLATES))}) AS t(template, license, body)
), template_words AS (
  SELECT template, license, word, count(*) AS n
  FROM (SELECT template, license, unnest(regexp_extract_all(lower(body), '{licenses.TOKEN}')) AS word FROM templates) GROUP BY ALL
), frequency AS (
  SELECT word, count(*) AS n FROM (SELECT unnest(list_distinct(words)) AS word FROM pieces) GROUP BY word
), idf AS (
  SELECT word, ln((1 + (SELECT count(*) FROM pieces)) / (1 + coalesce(n, 0))::DOUBLE) + 1 AS idf
  FROM (SELECT DISTINCT word FROM template_words) LEFT JOIN frequency USING (word)
), lengths AS (
  SELECT template, sqrt(sum((n * idf) ** 2)) AS norm FROM template_words JOIN idf USING (word) GROUP BY template
), posted AS (
  SELECT template, license, word, n * idf / norm AS weight FROM template_words JOIN idf USING (word) JOIN lengths USING (template)
), suspects AS (
  SELECT doc_id, place, words FROM pieces WHERE list_has_any(words, (SELECT list(word) FROM idf))
), weighed AS (
  SELECT doc_id, place, word, n * coalesce(idf, (SELECT max(idf) FROM idf)) AS x
  FROM (SELECT doc_id, place, word, count(*) AS n FROM (SELECT doc_id, place, unnest(words) AS word FROM suspects) GROUP BY ALL) LEFT JOIN idf USING (word)
), norms AS (
  SELECT doc_id, place, sqrt(sum(x * x)) AS norm FROM weighed GROUP BY ALL
), scores AS (
  SELECT doc_id, place, license, round(sum(x * weight) / any_value(norm), {licenses.DIGITS}) AS score
  FROM weighed JOIN posted USING (word) JOIN norms USING (doc_id, place) GROUP BY doc_id, place, template, license
  HAVING round(sum(x * weight) / any_value(norm), {licenses.DIGITS}) >= {licenses.THRESHOLD}
), own AS (
  SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, license, place) = 1
), declared AS (
  SELECT home AS directory, license AS said, score AS said_score FROM own JOIN files USING (doc_id)
  QUALIFY row_number() OVER (PARTITION BY home ORDER BY score DESC, path) = 1
), nearest AS (
  SELECT f.doc_id, d.directory, d.said, d.said_score FROM files f JOIN declared d ON f.home = d.directory OR starts_with(f.home, d.directory || '/')
  QUALIFY row_number() OVER (PARTITION BY f.doc_id ORDER BY length(d.directory) DESC) = 1
)
SELECT f.doc_id, f.path, coalesce(o.license, n.said) AS license, coalesce(o.score, n.said_score) AS score,
       CASE WHEN o.license IS NOT NULL THEN 'own' WHEN n.said IS NOT NULL THEN 'inherited' END AS origin,
       CASE WHEN o.license IS NULL THEN n.directory END AS directory
FROM files f LEFT JOIN own o USING (doc_id) LEFT JOIN nearest n USING (doc_id)
"""


@query("op6_licenses", LICENSE_SQL)
def op6_licenses(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as files in directories of ten, the first of a hundred above them; a file's licence speaks for its directory."""
    part = lambda n: F.floor(F.col("doc_id") / n).cast("string")
    name = F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))
    path = F.concat_ws("/", part(1000), part(100), F.when(F.col("doc_id") % 100 != 0, part(10)), name)
    files = table(spark, folder, "documents").select("doc_id", path.alias("path"), "text")
    return licenses.scan(files, speaks=F.lit(True))


#: words of documents and items in order, windows of items, and where documents hold them
LEAK_SQL = rf"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{decontaminate.WORD}') AS words
  FROM documents
), item_words AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{decontaminate.WORD}') AS words
  FROM benchmark
), item_windows AS (
  SELECT DISTINCT item_id, least(len(words), {decontaminate.WINDOW}) AS size,
         array_to_string(words[k : k + least(len(words), {decontaminate.WINDOW}) - 1], ' ') AS passage
  FROM (SELECT *, unnest(range(1, greatest(len(words) - {decontaminate.WINDOW} + 1, 1) + 1)) AS k FROM item_words WHERE len(words) > 0)
), sizes AS (
  SELECT DISTINCT size FROM item_windows
), places AS (
  SELECT doc_id, size, k, array_to_string(words[k : k + size - 1], ' ') AS passage
  FROM (SELECT doc_id, words, size, unnest(range(1, len(words) - size + 2)) AS k FROM words, sizes WHERE len(words) >= size)
), found AS (
  SELECT doc_id, size, k, item_id FROM places JOIN item_windows USING (size, passage)
), hit AS (
  SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(k, k + size)) AS place FROM found) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found WHERE item_id IS NOT NULL) GROUP BY doc_id
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""


@query("op11_decontaminate", LEAK_SQL)
def op11_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.scan(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id", "found.n_words", "found.n_hit", F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("found.items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("found.n_hit") > 0).alias("contaminated"),
    )


#: phrases of one to three words in pieces, their cuts and what longer ones absorb
PHRASE_SQL = rf"""
WITH pieces AS (
  SELECT coalesce(lang, '{collocations.UNKNOWN}') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), words AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM pieces
), grams AS (
  SELECT lang, size, array_to_string(words[k : k + size - 1], ' ') AS phrase
  FROM (SELECT lang, words, size, unnest(range(1, len(words) - size + 2)) AS k FROM words, (SELECT unnest(range(1, {collocations.LONGEST + 1})) AS size) WHERE len(words) >= size)
), counts AS (
  SELECT lang, size, phrase, count(*) AS f FROM grams GROUP BY ALL
), totals AS (
  SELECT lang, sum(f) AS n FROM counts WHERE size = 1 GROUP BY lang
), candidates AS (
  SELECT lang, phrase, size, f AS a, string_split(phrase, ' ') AS own FROM counts WHERE size > 1 AND f >= {collocations.LEAST}
), cuts AS (
  SELECT *, array_to_string(own[1 : k], ' ') AS first, array_to_string(own[k + 1 : size], ' ') AS rest FROM (SELECT *, unnest(range(1, size)) AS k FROM candidates)
), scored AS (
  SELECT c.lang, c.phrase, c.size, c.a, c.k, l.f AS l, r.f AS r, (1000000::HUGEINT * c.a * c.a) // (l.f::HUGEINT * r.f) AS score
  FROM cuts c JOIN counts l ON l.lang = c.lang AND l.phrase = c.first JOIN counts r ON r.lang = c.lang AND r.phrase = c.rest
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), longer AS (
  SELECT lang, array_to_string(own[s : s + w - 1], ' ') AS phrase, max(a) AS most
  FROM (SELECT *, unnest(range(1, size - w + 2)) AS s FROM (SELECT *, unnest(range(2, size)) AS w FROM candidates)) GROUP BY ALL
)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score
FROM best b JOIN totals USING (lang) LEFT JOIN longer g ON g.lang = b.lang AND g.phrase = b.phrase
WHERE coalesce(100 * most < {collocations.ABSORBED} * a, true)
QUALIFY rank <= {collocations.TOP}
"""


@query("op12_collocations", PHRASE_SQL)
def op12_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(table(spark, folder, "documents"))


#: term counts of documents and their scores for items, in whole numbers
RANKED_SQL = rf"""
WITH doc_terms AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{lexical.TERM}') AS terms FROM documents
), sizes AS (
  SELECT doc_id, len(terms) AS n FROM doc_terms WHERE len(terms) > 0
), stats AS (
  SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM sizes
), items AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{lexical.TERM}')) AS term
  FROM benchmark
), postings AS (
  SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM doc_terms) WHERE term IN (SELECT term FROM items) GROUP BY ALL
), weights AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM postings, stats GROUP BY term, n_docs
), norms AS (
  SELECT doc_id, 100 - 90 + (90 * n * n_docs) // n_terms AS m FROM sizes, stats
), scores AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM items JOIN postings USING (term) JOIN weights USING (term) JOIN norms USING (doc_id) GROUP BY item_id, doc_id
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= {lexical.TOP}
"""


@query("op13_lexical", RANKED_SQL)
def op13_lexical(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
