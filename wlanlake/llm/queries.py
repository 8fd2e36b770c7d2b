"""The registered queries of the numbered operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wlanlake.llm.common import table
from wlanlake.llm.conversations import damaged, repair_conversations
from wlanlake.llm.embedding_links import near_vectors
from wlanlake.llm.exact_dedup import exact_dedup
from wlanlake.llm.language import identify
from wlanlake.llm.licenses import BETWEEN, COPYRIGHT, KNOWN, SPELLINGS, scan_licenses
from wlanlake.llm.line_crf import line_quality
from wlanlake.llm.mixing import mix_sources
from wlanlake.llm.packing import pack
from wlanlake.llm.pairwise_quality import rank_quality
from wlanlake.llm.parity_join import near_duplicates
from wlanlake.llm.ranked_search import ranked_search
from wlanlake.llm.rans import token_files
from wlanlake.llm.warc import archive_pages


def op1_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = archive_pages(table(spark, sf_dir, "pages"))
    return captures.selectExpr(
        "metadata.page_id",
        "response.payload_bytes",
        "response.payload_digest",
        "response.type as record_type",
        "refers_to_page as refers_to",
    )


def op2_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages"))


def op4_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(table(spark, sf_dir, "documents"))


def op7_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op9_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).drop("source", "text_hash")


def op11_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(damaged(table(spark, sf_dir, "conversations")))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_warc_transactions": op1_warc_transactions,
    "op2_license_digests": op2_license_digests,
    "op3_language": op3_language,
    "op4_line_crf": op4_line_crf,
    "op5_pack": op5_pack,
    "op6_token_files": op6_token_files,
    "op7_parity_join": op7_parity_join,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_pairwise_quality": op9_pairwise_quality,
    "op10_mix_sources": op10_mix_sources,
    "op11_embedding_links": op11_embedding_links,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_ranked_search": op13_ranked_search,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"



def _base32(digest: str) -> str:
    """Base32 of a hex digest: five hex digits are a number below 2^20, which is four letters."""
    digit = "(instr('0123456789abcdef', substr({0}, i * 5 + {1}, 1)) - 1) * {2}"
    number = " + ".join(digit.format(digest, k + 1, 16 ** (4 - k)) for k in range(5))
    letters = " || ".join(
        f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ({number}) // {32**k} % 32 + 1, 1)" for k in (3, 2, 1, 0)
    )
    return f"array_to_string(list_transform(range(8), lambda i: {letters}), '')"


def _canonical(text: str) -> str:
    """The canonical form of licences, in SQL."""
    out = f"regexp_replace({text}, '{COPYRIGHT}', chr(10), 'g')"
    out = f"' ' || regexp_replace({out}, '{BETWEEN}', '  ', 'g') || ' '"
    for other, word in SPELLINGS:
        out = f"replace({out}, ' {other} ', ' {word} ')"
    return f"trim(replace({out}, '  ', ' '), ' ')"


_A_TO_Z = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_KNOWN = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in KNOWN)



def _add(cost: str, letter: str, packed: str) -> str:
    """An edit before a packed way to the end, which is nine digits of cost and the audit."""
    return f"lpad((substr({packed}, 1, 9)::INT + {cost})::VARCHAR, 9, '0') || '{letter}' || substr({packed}, 10)"


_NO_WAY = "'999999999'"


def _step(state: int) -> str:
    """The best way on from a state of the pattern (start, s, u, a) when a row is read; p0 to p3 are the ways after it."""
    turn = (2, 2, 3, 2)[state]
    keep = {0: "CASE initial WHEN 's' THEN {s} WHEN 'u' THEN {u} ELSE {no} END", 2: "CASE initial WHEN 'a' THEN {a} ELSE {no} END"}
    keep = keep.get(state, "CASE initial WHEN 'u' THEN {u} ELSE {no} END")
    kept = keep.format(s=_add("more", "K", "p1"), u=_add("more", "K", "p2"), a=_add("more", "K", "p3"), no=_NO_WAY)
    return (
        f"least({_add('2', 'D', f'p{state}')}, CASE WHEN fault IN (1, 2) THEN {_NO_WAY} "
        f"ELSE least({_add('1 + more', 'R', f'p{turn}')}, {kept}) END)"
    )


# Inserts at one place: at most two are of use, as a third leads back to where the first one began.
_INSERTED = f"""least(r0, {_add("5", "I", "r2")}, {_add("10", "II", "r3")}) AS p0,
  least(r1, {_add("5", "I", "r2")}, {_add("10", "II", "r3")}) AS p1,
  least(r2, {_add("5", "I", "r3")}) AS p2, least(r3, {_add("5", "I", "r2")}) AS p3"""
_TERMS = f"""string_split_regex({_LOWER}, '[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"""

ORACLES = {
    "op1_warc_transactions": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
g AS (SELECT payload, min(page_id) AS first FROM p GROUP BY payload)
SELECT page_id, strlen(payload)::BIGINT AS payload_bytes, {_base32("sha1(payload)")} AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to FROM p JOIN g USING (payload)""",
    "op2_license_digests": f"""
WITH k AS (SELECT DISTINCT license, sha256({_canonical(_A_TO_Z.format("text"))}) AS text_digest
  FROM (VALUES {_KNOWN}) AS known(license, text)),
d AS (SELECT doc_id, {_A_TO_Z.format("coalesce(text, '')")} AS content FROM documents),
n AS (SELECT doc_id, license FROM (SELECT doc_id, unnest(string_split(content, chr(10))) AS line FROM d) JOIN k
  ON sha256({_canonical("line")}) = text_digest WHERE contains(line, 'licen')),
l AS (SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS notices FROM n GROUP BY doc_id)
SELECT doc_id, text_digest, license, coalesce(notices, '') AS notices
FROM (SELECT doc_id, sha256({_canonical("content")}) AS text_digest FROM d)
LEFT JOIN k USING (text_digest) LEFT JOIN l USING (doc_id)""",
    "op8_exact_dedup": f"""
WITH d AS (SELECT doc_id, {_LOWER} AS content FROM documents),
g AS (SELECT content, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY content)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(content) AS text_sha256
FROM d JOIN g USING (content)""",
    # Sources in order of cap / weight: the first one that the level of the rest does not fill ends the capped ones.
    "op10_mix_sources": r"""
WITH d AS (SELECT doc_id, source,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
    1 + (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 AS w FROM d GROUP BY source),
o AS (SELECT *, sum(source_size) OVER ()::BIGINT - coalesce(sum(3 * source_size) OVER before, 0)::BIGINT AS rest,
    sum(w) OVER ()::BIGINT - coalesce(sum(w) OVER before, 0)::BIGINT AS weight,
    row_number() OVER (ORDER BY 3.0 * source_size / w, source) AS k FROM s
    WINDOW before AS (ORDER BY 3.0 * source_size / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT k AS first_free, rest, weight FROM o WHERE w * rest <= 3 * source_size * weight ORDER BY k LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN k < first_free THEN (3 * source_size)::DOUBLE
    ELSE (w * level.rest)::DOUBLE / level.weight::DOUBLE END AS target FROM o, level),
p AS (SELECT doc_id, size, source_size, target, floor(target)::BIGINT AS budget,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY md5('mix:' || coalesce(doc_id::VARCHAR, ''))
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (CASE WHEN source_size = 0 THEN 0 ELSE budget // source_size * size
    + least(greatest(budget % source_size - before, 0), size) END)::BIGINT AS taken FROM p""",
    "op11_embedding_links": """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE len(embedding) > 0
    AND list_count(embedding) = len(embedding) AND list_bool_and(list_transform(embedding, lambda x: isfinite(x)))
    AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT a AS vec_id, a AS other FROM links UNION SELECT vec_id, b FROM reach JOIN links ON other = a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a),
c AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, coalesce(component_id, vec_id) AS component_id,
  coalesce(component_id, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN n USING (vec_id) LEFT JOIN c USING (vec_id)""",
    # The edits by dynamic programming from the last row to the first; the checksum by its table of 256 remainders.
    "op12_conversation_repair": f"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i:
    list_reduce(list_concat([i], range(8)), lambda a, b: xor(a >> 1, 3988292384 * (a & 1)))) AS t),
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_concat([4294967295], list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' ||
      coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT)),
      lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 20 AS kind FROM conversations, crc),
d AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM k WHERE kind <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(len(role) || ':' || role || text)) AS i,
    substr(role, 1, 1) AS initial FROM d),
s AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS previous FROM o),
f AS (SELECT *, CASE WHEN fault = 3 THEN 5 ELSE 0 END AS more FROM (SELECT *,
    CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 1 WHEN nth > 1 THEN 2
      WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 3 ELSE 0 END AS fault FROM s)),
g AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
    count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
    count(*) FILTER (previous IS NOT NULL AND previous || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
dp AS (SELECT conv_id, n AS i, '000000000' AS p0, '000000010II' AS p1, '000000005I' AS p2, '000000000' AS p3 FROM g
  UNION ALL SELECT conv_id, i - 1, {_INSERTED} FROM (SELECT dp.conv_id, dp.i, {", ".join(f"{_step(k)} AS r{k}" for k in range(4))}
    FROM dp JOIN f ON f.conv_id IS NOT DISTINCT FROM dp.conv_id AND f.i = dp.i)),
e AS (SELECT conv_id, substr(p0, 1, 9)::BIGINT AS cost, substr(p0, 10) AS audit FROM dp WHERE i = 0),
l AS (SELECT conv_id, k, letter, count(*) FILTER (letter <> 'I') OVER w AS i, count(*) FILTER (letter <> 'D') OVER w AS place
    FROM (SELECT conv_id, audit, k, substr(audit, k, 1) AS letter FROM (SELECT *, unnest(range(1, len(audit) + 1)) AS k FROM e))
    WINDOW w AS (PARTITION BY conv_id ORDER BY k)),
x AS (SELECT l.conv_id, k, letter, place, role, text,
    max(CASE WHEN place = 1 AND letter = 'K' AND initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY l.conv_id) AS system
    FROM l LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM l.conv_id AND f.i = l.i WHERE letter <> 'D'),
h AS (SELECT conv_id, sha256(string_agg(CASE WHEN letter = 'K' THEN role WHEN (place - system) % 2 = 1 THEN 'user'
    ELSE 'assistant' END || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY k)) AS sha FROM x GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit,
  coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN h ON h.conv_id IS NOT DISTINCT FROM c.conv_id""",
    "op13_ranked_search": f"""
WITH d AS (SELECT row_number() OVER () AS doc, doc_id, {_TERMS} AS terms FROM documents),
t AS (SELECT doc, doc_id, term, count(*) AS tf FROM (SELECT doc, doc_id, unnest(terms) AS term FROM d)
    WHERE term <> '' GROUP BY ALL),
l AS (SELECT doc, sum(tf)::BIGINT AS n FROM t GROUP BY doc),
whole AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM l),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
    FROM t, whole GROUP BY term, n_docs),
q AS (SELECT DISTINCT item, item_id, unnest(terms) AS term FROM
    (SELECT row_number() OVER () AS item, item_id, {_TERMS} AS terms FROM benchmark)),
s AS (SELECT item, item_id, doc, doc_id,
    sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms))))::BIGINT AS score
    FROM q JOIN w USING (term) JOIN t USING (term) JOIN l USING (doc), whole GROUP BY ALL)
SELECT item_id, rank, doc_id, score FROM (SELECT item_id, doc_id, score,
    row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id)::INT AS rank FROM s WHERE score > 0) WHERE rank <= 10""",
}
