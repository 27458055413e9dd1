"""One registered query per operator, with SQL where it can express the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import (
    align, decontaminate, exact_dedup, fm_index, language_id, license_scan, ngram_join, pack, repair, sharding, sparse_suffix, token_files, toxicity)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SQL_LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: CRC-32: its table, the bytes of a text, and the checksum of a list `bytes`.
SQL_CRC_TABLE = """crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc)"""
SQL_BYTES = "list_transform(regexp_extract_all(hex(encode({})), '..'), lambda h: ('0x' || h)::BIGINT)"
SQL_CRC = "xor(list_reduce(list_prepend(4294967295, bytes), lambda x, y: xor(x >> 8, crc[(xor(x, y) & 255) + 1])), 4294967295)"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


_phrases = ", ".join(f"('{p}', '{label}', {len(p.split())})" for p, label in license_scan.PHRASES.items())
_notices = ", ".join("('{}', '{}')".format(label, text.replace("'", "''")) for label, text in license_scan.NOTICES.items())


@query("op2_license_scan")
def op2_license_scan(spark, sf):
    return license_scan.scan_licenses(documents(spark, sf))


@query("op4_exact_dedup", r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, length(t) AS points, regexp_replace(t, '[\x20\x09-\x0D]', '', 'g') AS content FROM d),
k AS (SELECT doc_id, content, first_value(doc_id) OVER (PARTITION BY content ORDER BY points DESC, doc_id) AS keep_id,
             count(*) OVER (PARTITION BY content) AS group_size FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(content) AS text_sha256 FROM k""")
def op4_exact_dedup(spark, sf):
    return exact_dedup.mark_copies(documents(spark, sf))


@query("op7_decontamination", rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({SQL_LOWER.format('text')}, '{SQL_WORD}') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all({SQL_LOWER.format('text')}, '{SQL_WORD}') AS w FROM benchmark),
il AS (SELECT item_id, w, least(len(w), 13) AS l FROM i WHERE len(w) > 0),
ig AS (SELECT DISTINCT item_id, l, array_to_string(w[p : p + l - 1], ' ') AS gram
       FROM (SELECT item_id, w, l, unnest(range(1, len(w) - l + 2)) AS p FROM il)),
ls AS (SELECT DISTINCT l FROM ig),
dg AS (SELECT doc_id, l, p, array_to_string(w[p : p + l - 1], ' ') AS gram
       FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS p FROM d, ls)),
h AS (SELECT doc_id, p, l, item_id FROM dg JOIN ig USING (l, gram)),
c AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + l)) AS q FROM h) GROUP BY doc_id),
s AS (SELECT doc_id, count(DISTINCT item_id) AS n_items,
             sha256(string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR)) AS items FROM h GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(items, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN s USING (doc_id)""")
def op7_decontamination(spark, sf):
    return decontaminate.mark_contaminated(documents(spark, sf), spark.read.parquet(f"{sf}/benchmark.parquet"))


@query("op6_token_files")
def op6_token_files(spark, sf):
    return token_files.round_trip(documents(spark, sf))


@query("op8_best_fit_packing")
def op8_best_fit_packing(spark, sf):
    return pack.pack_documents(documents(spark, sf))


@query("op9_toxicity")
def op9_toxicity(spark, sf):
    return toxicity.score_held_out(documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet"))


@query("op10_language_id")
def op10_language_id(spark, sf):
    return language_id.identify_held_out(documents(spark, sf))


@query("op3_ngram_jaccard_join")
def op3_ngram_jaccard_join(spark, sf):
    return ngram_join.similar_documents(documents(spark, sf))


@query("op1_suffix_array_dedup")
def op1_suffix_array_dedup(spark, sf):
    return sparse_suffix.repeated_passages(documents(spark, sf))


@query("op5_substring_dedup", r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, p, array_to_string(w[p : p + 49], ' ') AS gram
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM d)),
f AS (SELECT gram, min(doc_id) AS first_id FROM g GROUP BY gram HAVING min(doc_id) < max(doc_id)),
r AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS q FROM g JOIN f USING (gram) WHERE doc_id > first_id),
k AS (SELECT d.doc_id, x.q, x.word FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS q FROM d) x JOIN d USING (doc_id)),
t AS (SELECT k.doc_id, count(*) AS n_kept, string_agg(word, ' ' ORDER BY q) AS body FROM k ANTI JOIN r USING (doc_id, q) GROUP BY k.doc_id)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n_kept, 0) AS n_removed, sha256(coalesce(body, '')) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id)""")
def op5_substring_dedup(spark, sf):
    return fm_index.remove_repeats(documents(spark, sf))


@query("op11_cross_tokenizer_alignment")
def op11_cross_tokenizer_alignment(spark, sf):
    return align.alignment_counts(documents(spark, sf))


_edges = ", ".join(f"('{kind}', {a}, {b}, {x >> repair.SLOT}, '{repair.letters_of(x, 1)}')" for kind, matrix in repair.EDGES.items()
                   for a, row in enumerate(matrix) for b, x in enumerate(row) if x is not None)


@query("op12_conversation_repair", f"""
WITH RECURSIVE {SQL_CRC_TABLE},
b AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
             {SQL_BYTES.format("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} AS bytes FROM conversations),
h AS (SELECT conv_id, turn, role, text, {SQL_CRC} % 20 AS harm FROM b, crc),
r AS (SELECT conv_id, turn, CASE WHEN harm = 4 THEN 'user' ELSE role END AS role,
             CASE harm WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
             unnest(range(CASE harm WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM h),
u AS (SELECT *, row_number() OVER () AS own FROM r),
o AS (SELECT conv_id, turn, role, text, left(role, 1) AS initial, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, own) AS k,
             row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, own) AS time FROM u),
f AS (SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY k) AS initial_before,
             CASE WHEN body = '' THEN 'blank' WHEN time > 1 THEN 'duplicate' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault FROM o),
kind AS (SELECT *, CASE WHEN fault IN ('blank', 'duplicate') THEN 'X' WHEN fault = 'truncated' THEN upper(own) ELSE own END AS kind
         FROM (SELECT *, CASE WHEN initial IN ('s', 'u', 'a') THEN initial ELSE 'o' END AS own FROM f)),
edge(kind, src, dst, price, letters) AS (VALUES {_edges}),
sums AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
                count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
                count(*) FILTER (initial_before || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM kind GROUP BY conv_id),
path AS (SELECT conv_id, 0 AS k, 0 AS state, {{'cost': 0, 'audit': ''}} AS v FROM sums
         UNION ALL SELECT p.conv_id, p.k + 1, dst, min({{'cost': p.v.cost + price, 'audit': p.v.audit || letters}})
         FROM path p JOIN kind ON kind.conv_id IS NOT DISTINCT FROM p.conv_id AND kind.k = p.k + 1 JOIN edge ON edge.kind = kind.kind AND src = state
         GROUP BY p.conv_id, p.k, dst),
best AS (SELECT p.conv_id, min({{'cost': p.v.cost + price, 'audit': p.v.audit || letters}}) AS v
         FROM path p JOIN sums s ON s.conv_id IS NOT DISTINCT FROM p.conv_id AND s.n = p.k JOIN edge ON kind = '.' AND src = state GROUP BY p.conv_id),
letter AS (SELECT conv_id, unnest(range(1, len(v.audit) + 1)) AS pos, v.audit AS audit FROM best),
placed AS (SELECT conv_id, pos, audit[pos] AS letter, len(regexp_replace(audit[1:pos], 'I', '', 'g')) AS k FROM letter),
kept AS (SELECT p.conv_id, pos, letter, role, text, row_number() OVER (PARTITION BY p.conv_id ORDER BY pos) AS place,
                first_value(letter = 'K' AND initial = 's') OVER (PARTITION BY p.conv_id ORDER BY pos) AS begun
         FROM placed p LEFT JOIN kind ON kind.conv_id IS NOT DISTINCT FROM p.conv_id AND kind.k = p.k AND letter <> 'I' WHERE letter <> 'D'),
line AS (SELECT conv_id, pos, CASE WHEN letter = 'K' THEN role WHEN (place - coalesce(begun, false)::INTEGER) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':'
                || coalesce(text, '') AS line FROM kept),
body AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY pos) AS body FROM line GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(best.v.cost, 0) AS cost, coalesce(best.v.audit, '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN sums ON sums.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN body ON body.conv_id IS NOT DISTINCT FROM c.conv_id""")
def op12_conversation_repair(spark, sf):
    return repair.damage_and_repair(spark.read.parquet(f"{sf}/conversations.parquet"))


def _turns() -> str:
    """The rounds of the permutation, each a table made from the one before."""
    out = []
    for k in range(sharding.ROUNDS):
        half, other, side = ("l", "r", "a") if k % 2 == 0 else ("r", "l", "b")
        mixed = f"('0x' || substr(md5('{sharding.SEED}:{k}:' || {other}), 1, 15))::BIGINT"
        out.append(f"t{k + 1} AS (SELECT n, a, b, total, {other}, ({half} + {mixed} % {side}) % {side} AS {half} FROM t{k})")
    return ",\n".join(out)


@query("op13_sharding", f"""
WITH RECURSIVE {SQL_CRC_TABLE},
d AS (SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, {SQL_BYTES.format("coalesce(text, '')")} AS bytes FROM documents),
c AS (SELECT doc_id, size, {SQL_CRC} AS text_crc32 FROM d, crc),
numbered AS (SELECT *, row_number() OVER (ORDER BY md5(coalesce(doc_id::VARCHAR, 'null')), text_crc32, size) - 1 AS number FROM c),
total AS (SELECT count(*) AS total, ceil(sqrt(count(*)))::BIGINT AS root FROM documents),
grid AS (SELECT a, (total + a - 1) // a AS b, total
         FROM (SELECT total, unnest(range(root, least(root + {sharding.SIDES}, root + root // 2) + 1)) AS a FROM total)
         ORDER BY a * ((total + a - 1) // a), a LIMIT 1),
t0 AS (SELECT n, a, b, total, n // b AS l, n % b AS r FROM (SELECT *, unnest(range(a * b)) AS n FROM grid)),
{_turns()},
once AS (SELECT n, total, l * b + r AS p FROM t{sharding.ROUNDS}),
walk AS (SELECT n, total, p FROM once WHERE n < total
         UNION ALL SELECT walk.n, walk.total, once.p FROM walk JOIN once ON once.n = walk.p WHERE walk.p >= walk.total)
SELECT doc_id, size, text_crc32, 'rows' AS law, (p % {sharding.SHARDS})::INTEGER AS shard, p // {sharding.SHARDS} AS slot,
       NULL::INTEGER AS grown_shard
FROM numbered JOIN walk ON n = number AND p < total""")
def op13_sharding(spark, sf):
    return sharding.place_documents(documents(spark, sf))
