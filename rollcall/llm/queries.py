"""The registered queries of this subpackage and the SQL that must agree with them."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rollcall.llm.conversations import damaged, repaired
from rollcall.llm.decontaminate import contamination
from rollcall.llm.fingerprints import edited_fingerprints
from rollcall.llm.licenses import PHRASES, TEMPLATES, license_scan
from rollcall.llm.near_dedup import near_groups
from rollcall.llm.passages import shared_passages
from rollcall.llm.quality import quality
from rollcall.llm.segment import sampled_segmentations
from rollcall.llm.token_counts import token_counts
from rollcall.llm.token_files import read_tokens, token_digests, write_tokens
from rollcall.llm.toxicity import toxicity
from rollcall.llm.warc import read_archives, write_archives
from rollcall.llm.whitening import whitened
from rollcall.llm.work import documents
from rollcall.storage import work_path

SEGMENTATIONS = 3  # sampled for each text
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str):
    def add(build):
        QUERIES[name] = build
        return build

    return add


def vocabulary(name: str) -> str:
    """Where the installed public tokenizer files are."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_near_dedup")
def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(documents(spark, sf_dir), shingle=4, percent=80)


@query("op3_passages")
def op3_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_passages(documents(spark, sf_dir))


@query("op4_decontamination")
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"), width=10)
    return found.drop("hits", "items")


@query("op5_licenses")
def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir)).drop("n_templates")


@query("op6_token_files")
def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = work_path(spark, "tokens")
    write_tokens(documents(spark, sf_dir), out, vocabulary("byte_bpe_50k.json"))
    return token_digests(read_tokens(spark, out))


@query("op7_segmentations")
def op7_segmentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampled_segmentations(documents(spark, sf_dir), vocabulary("piece_bpe_32k.model"), k=SEGMENTATIONS, digest=True,
                                 with_ids=True)


@query("op8_toxicity")
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


@query("op9_token_counts")
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"), limit=2048)


@query("op10_quality")
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


@query("op2_warc")
def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_path(spark, "warc")
    files = write_archives(documents(spark, sf_dir, "pages"), folder)
    return read_archives(spark, folder, files).drop("url", "stored_bytes")


@query("op11_fingerprints")
def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(documents(spark, sf_dir))


@query("op12_conversations")
def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(damaged(documents(spark, sf_dir, "conversations")))


@query("op13_whitening")
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(documents(spark, sf_dir, "embeddings"), components=32)


def _words(column: str, pattern: str, lower: bool = True) -> str:
    text = f"coalesce({column}, '')"
    if lower:
        text = f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"regexp_extract_all({text}, '{pattern}')"


BLANK = r"[^\x20\x09-\x0D]+"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

SQL["op1_near_dedup"] = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_words("text", BLANK)} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 4
    THEN list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS g FROM d),
n AS (SELECT doc_id, len(g) AS n FROM s),
e AS (SELECT doc_id, unnest(g) AS g FROM s),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY ALL),
l AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 80 * (x.n + y.n - c)),
b AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
r AS (SELECT doc_id AS root, doc_id AS node FROM n UNION SELECT r.root, b.v FROM r JOIN b ON b.u = r.node)
SELECT n.doc_id, n.n AS n_shingles, m.c AS component_id, n.doc_id = m.c AS kept FROM n
JOIN (SELECT node, min(root) AS c FROM r GROUP BY node) m ON m.node = n.doc_id"""

SQL["op2_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p WHERE strlen(h) >= 100 GROUP BY h)
SELECT page_id, strlen(p.h)::BIGINT AS payload_bytes, sha256(p.h) AS payload_digest,
  CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first < page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON p.h = f.h"""

SQL["op4_decontamination"] = f"""
WITH d AS (SELECT doc_id, {_words("text", ALNUM)} AS w FROM documents),
i AS (SELECT item_id, {_words("text", ALNUM)} AS w FROM benchmark),
c AS (SELECT item_id, w, least(10, len(w)) AS k FROM i WHERE len(w) > 0),
x AS (SELECT DISTINCT item_id, k, array_to_string(w[j:j + k - 1], ' ') AS g
  FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS j FROM c)),
y AS (SELECT doc_id, k, j, array_to_string(w[j:j + k - 1], ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS j
    FROM d, (SELECT DISTINCT k FROM x) WHERE len(w) >= k)),
m AS (SELECT doc_id, j, x.k, item_id FROM y JOIN x ON x.g = y.g AND x.k = y.k),
h AS (SELECT doc_id, count(DISTINCT place) AS n_hit
  FROM (SELECT doc_id, unnest(range(j, j + k)) AS place FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)"""


def _template_pattern(template: str) -> str:
    """A template as a pattern over words that are each followed by a blank."""
    out = []
    for token in re.findall(r"<<[^>]*>>|[^\s<>]+", template.lower()):
        if token == "<<beginoptional>>":
            out.append("(?:")
        elif token == "<<endoptional>>":
            out.append(")?")
        elif token.startswith("<<var"):
            out.append(f"(?:[^ ]+ ){{0,{token.strip('<>').split(';')[1]}}}")
        else:
            out.append(f"{token} ")
    return " " + "".join(out)


def _license_sql() -> str:
    places = []
    for phrase in PHRASES:
        test = " AND ".join(f"w[j + {n}] = '{word}'" for n, word in enumerate(phrase.split(), 1))
        places.append(f"list_filter(range(0, len(w)), lambda j: {test})")
    base = ", ".join(f"CASE WHEN len(p{n}) > 0 THEN '{label}' END" for n, label in enumerate(PHRASES.values()))
    whole = ", ".join(
        "CASE WHEN " + " OR ".join(f"regexp_matches(t, '{_template_pattern(x)}')" for x in found) + f" THEN '{label}' END"
        for label, found in TEMPLATES.items())
    columns = ", ".join(f"{p} AS p{n}" for n, p in enumerate(places))
    joined = "list_concat(" * (len(places) - 1) + "p0" + "".join(f", p{n})" for n in range(1, len(places)))
    tidy = "array_to_string(list_sort(list_distinct(list_filter({}, lambda z: z IS NOT NULL))), ',')"
    return f"""
WITH d AS (SELECT doc_id, {_words("text", ALNUM)} AS w FROM documents),
f AS (SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS t, {columns} FROM d),
g AS (SELECT doc_id, len(w) AS n_words, {joined} AS p, [{base}] AS b, [{whole}] AS m FROM f)
SELECT doc_id, n_words, len(p)::BIGINT AS n_base, list_min(p) AS first_word, list_max(p) AS last_word,
  {tidy.format("b")} AS base_labels, {tidy.format("list_concat(b, m)")} AS labels,
  CASE WHEN len(list_filter(m, lambda z: z IS NOT NULL)) > 0 THEN 1.0 WHEN len(p) > 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS score
FROM g"""


SQL["op5_licenses"] = _license_sql()

#: The crc32 of an ASCII text, eight bits a step.
_CRC = """xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split({0}, ''), lambda c: ascii(c)::BIGINT)),
  lambda a, b: list_reduce(list_concat([xor(a, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
    lambda d, k: xor(d >> 1, 3988292384 * (d & 1)))), 4294967295)"""

SQL["op12_conversations"] = f"""
WITH RECURSIVE s AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {_CRC.format("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS k FROM conversations),
d AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
    CASE k WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(range(CASE k WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS again FROM s),
m AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM d),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS seen, role[1] AS x,
    rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM m),
f AS (SELECT *, CASE WHEN body = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate'
    WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
    lag(x) OVER (PARTITION BY conv_id ORDER BY i) || x AS pair FROM n),
c AS (SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS rows FROM f GROUP BY conv_id),
e(letter, price) AS (VALUES ('D', 4), ('K', 0), ('R', 3)),
p AS (SELECT DISTINCT conv_id, 0::BIGINT AS i, '' AS state, {{'cost': 0::BIGINT, 'audit': '', 'text': ''}} AS b FROM s
  UNION ALL
  SELECT conv_id, i, state, min({{'cost': cost, 'audit': audit, 'text': text}}) FROM (
    SELECT q.conv_id, f.i, CASE WHEN letter = 'D' THEN q.state WHEN letter = 'K' THEN x ELSE q.give END AS state,
      cost + price + CASE WHEN letter <> 'D' AND fault = 'truncated' THEN 3 ELSE 0 END AS cost, audit || letter AS audit,
      q.text || CASE WHEN letter = 'D' THEN ''
        ELSE chr(10) || CASE WHEN letter = 'K' THEN role WHEN q.give = 'u' THEN 'user' ELSE 'assistant' END || ':' || f.text END AS text
    FROM (SELECT *, CASE state WHEN 'u' THEN 'a' ELSE 'u' END AS give FROM (
        SELECT conv_id, i, CASE WHEN add = 0 THEN state WHEN state = 'u' THEN 'a' ELSE 'u' END AS state,
          b.cost + 3 * add AS cost, b.audit || CASE WHEN add = 0 THEN '' ELSE 'I' END AS audit,
          b.text || CASE WHEN add = 0 THEN '' WHEN state = 'u' THEN chr(10) || 'assistant:' ELSE chr(10) || 'user:' END AS text
        FROM (SELECT *, unnest([0, 1]) AS add FROM p))) q
    JOIN f ON f.conv_id IS NOT DISTINCT FROM q.conv_id AND f.i = q.i + 1 CROSS JOIN e
    WHERE letter = 'D' OR fault IS NULL AND letter = 'R' OR fault = 'truncated' AND letter = 'R'
      OR (fault IS NULL OR fault = 'truncated') AND (x = q.give OR x = 's' AND q.state = ''))
  GROUP BY conv_id, i, state),
z AS (SELECT p.conv_id, min({{'cost': b.cost + 3 * add, 'audit': b.audit || CASE WHEN add = 0 THEN '' ELSE 'I' END,
    'text': b.text || CASE WHEN add = 0 THEN '' ELSE chr(10) || 'assistant:' END}}) AS b
  FROM (SELECT *, unnest([0, 1]) AS add FROM p) p LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM p.conv_id
  WHERE i = coalesce(rows, 0) AND (add = 0 AND state IN ('', 'a') OR add = 1 AND state = 'u') GROUP BY p.conv_id)
SELECT z.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, b.cost AS cost, b.audit AS audit,
  sha256(b.text[2:]) AS repaired_sha256 FROM z LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM z.conv_id"""
