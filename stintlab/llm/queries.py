"""The registered queries of this subpackage and, where SQL can say the same, their DuckDB text."""

from __future__ import annotations

from collections.abc import Callable
from html.entities import html5

from pyspark.sql import DataFrame, SparkSession

from stintlab.llm import bpe, decontaminate, dual_tree, jaccard, langid, mix, nn_descent, phrases, secrets, suffixes, token_files, toxicity, warc
from stintlab.llm.common import read


def op1_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.near_duplicates(read(spark, sf_dir, "embeddings"))


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(read(spark, sf_dir, "documents"))


def op3_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(read(spark, sf_dir, "documents"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_join(read(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derivatives(warc.responses(read(spark, sf_dir, "pages")))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read(spark, sf_dir, "documents"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.store_and_read(read(spark, sf_dir, "documents"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(read(spark, sf_dir, "documents"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(read(spark, sf_dir, "documents"))


def op12_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.mix(read(spark, sf_dir, "documents")).drop("copies")


def op13_dual_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dual_tree.cluster(read(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_nn_descent": op1_nn_descent,
        "op2_bpe_round_trip": op2_bpe_round_trip,
        "op3_suffix_array": op3_suffix_array,
        "op4_jaccard_join": op4_jaccard_join,
        "op5_toxicity": op5_toxicity,
        "op6_warc": op6_warc,
        "op7_decontaminate": op7_decontaminate,
        "op8_language": op8_language,
        "op9_token_files": op9_token_files,
        "op10_secrets": op10_secrets,
        "op11_phrases": op11_phrases,
        "op12_mix": op12_mix,
        "op13_dual_tree": op13_dual_tree,
    }


_VECTORS = """WITH RECURSIVE x AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
 p AS (SELECT a.vec_id AS u, b.vec_id AS v FROM x a JOIN x b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
 r AS (SELECT vec_id AS u, vec_id AS v FROM x UNION SELECT r.u, p.v FROM r JOIN p ON r.v = p.u)
 SELECT vec_id, coalesce(n, 0) AS n_links, c AS component_id, vec_id = c AS kept FROM x
 LEFT JOIN (SELECT u, count(*) AS n FROM p GROUP BY 1) l ON l.u = vec_id JOIN (SELECT u, min(v) AS c FROM r GROUP BY 1) m ON m.u = vec_id"""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_WINDOWS = f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
 bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS s FROM b, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS t(i) WHERE len(w) > 0),
 ns AS (SELECT DISTINCT n FROM bw),
 dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s FROM d, ns, unnest(range(1, len(w) - n + 2)) AS t(i)),
 hit AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, s)),
 ps AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY 1),
 it AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hit) GROUP BY 1)
 SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
 FROM d LEFT JOIN ps USING (doc_id) LEFT JOIN it USING (doc_id)"""


_PHRASES = r"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
 w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
 x AS (SELECT lang, k AS size, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM w CROSS JOIN range(1, 5) AS s(k)),
 g AS (SELECT lang, size, phrase, count(*) AS f FROM x GROUP BY ALL),
 c AS (SELECT *, string_split(phrase, ' ') AS v FROM g WHERE size > 1 AND f >= 30),
 cuts AS (SELECT lang, phrase, size, f, k, array_to_string(v[1:k], ' ') AS x, array_to_string(v[k + 1:], ' ') AS y FROM c JOIN range(1, 4) AS s(k) ON k < size),
 s AS (SELECT cuts.*, l.f AS l, r.f AS r, CAST(CAST(2000000 AS HUGEINT) * cuts.f // (l.f + r.f) AS BIGINT) AS score FROM cuts JOIN g l ON l.lang = cuts.lang AND l.phrase = x JOIN g r ON r.lang = cuts.lang AND r.phrase = y),
 b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
 y AS (SELECT lang, f, unnest(list_transform(range(1, size - m + 2), lambda j: array_to_string(v[j:j + m - 1], ' '))) AS phrase FROM c JOIN range(2, 4) AS s(m) ON m < size),
 i AS (SELECT lang, phrase, max(f) AS longer FROM y GROUP BY ALL),
 n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM g WHERE size = 1 GROUP BY 1)
 SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, b.f DESC, b.phrase) AS rank, b.phrase, b.f AS a, l, r, n, score
 FROM b JOIN n USING (lang) LEFT JOIN i ON i.lang = b.lang AND i.phrase = b.phrase WHERE coalesce(100 * longer < 80 * b.f, true) QUALIFY rank <= 2000"""


_MIX = r"""WITH d AS (SELECT doc_id, coalesce('s' || source, 't') AS key, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
 s AS (SELECT key, CAST(sum(size) AS BIGINT) AS source_size, 1 + (row_number() OVER (ORDER BY key) - 1) % 3 AS w FROM d GROUP BY key),
 o AS (SELECT *, row_number() OVER r AS i, sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS num,
 sum(w) OVER () - coalesce(sum(w) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS den FROM s WINDOW r AS (ORDER BY source_size / w, key)),
 f AS (SELECT CAST(num AS BIGINT) AS num, CAST(den AS BIGINT) AS den FROM o WHERE w * num <= 3 * source_size * den ORDER BY i LIMIT 1),
 t AS (SELECT key, source_size, CASE WHEN w * num > 3 * source_size * den THEN CAST(3 * source_size AS DOUBLE) ELSE CAST(w * num AS DOUBLE) / CAST(den AS DOUBLE) END AS target FROM s, f),
 n AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0.0 END AS whole FROM d JOIN t USING (key)),
 u AS (SELECT *, target - whole * source_size AS rest, (CAST(CAST('0x' || substr(md5(concat(coalesce(CAST(doc_id AS VARCHAR), ''), '|', size, '|mix-1')), 1, 13) AS BIGINT) AS DOUBLE) + CAST(0.5 AS DOUBLE)) / CAST(4503599627370496 AS DOUBLE) AS u FROM n),
 q AS (SELECT *, (u / (1 - u)) / ((rest / source_size) / (1 - rest / source_size)) AS odds, size > 0 AND rest > 0 AS due FROM u),
 b AS (SELECT *, sum(CASE WHEN due THEN size ELSE 0 END) OVER (PARTITION BY key, due ORDER BY odds / (1 + odds), doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) - size AS before FROM q)
 SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN due AND 2 * before + size <= 2 * rest THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM b"""


def _lloyd_sql(rounds: int = dual_tree.ROUNDS) -> str:
    far = "CAST(list_sum(list_transform(list_zip(p, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT)"
    steps = [
        """e AS MATERIALIZED (SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS p
 FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""",
        """c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS k, p AS c FROM (SELECT p, sha256('2:' || vec_id) AS h FROM e ORDER BY h LIMIT 40))""",
    ]
    for n in range(rounds + 1):
        steps.append(f"a{n} AS MATERIALIZED (SELECT i, vec_id, p, k, {far} AS d FROM e CROSS JOIN c{n} QUALIFY row_number() OVER (PARTITION BY i ORDER BY d, k) = 1)")
        if n < rounds:
            steps.append(f"""c{n + 1} AS MATERIALIZED (SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS c
 FROM (SELECT k, j, sum(x) AS s, count(*) AS n FROM (SELECT k, unnest(p) AS x, unnest(range(1, 65)) AS j FROM a{n}) GROUP BY k, j) GROUP BY k
 UNION ALL SELECT k, c FROM c{n} WHERE k NOT IN (SELECT k FROM a{n}))""")
    return f"""WITH {', '.join(steps)} SELECT vec_id, CAST(k AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia,
 CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} USING (k)"""


def _quoted(text: str) -> str:
    """A SQL literal; control characters by their codes."""
    parts = text.replace("'", "''").replace("\r", "' || chr(13) || '").replace("\n", "' || chr(10) || '")
    return f"('{parts}')"


def _warc_sql() -> str:
    plain = "payload"
    for pattern, by in warc.TEXT_STEPS:
        plain = f"regexp_replace({plain}, {_quoted(pattern)}, {_quoted(by)}, 'g')"
    # every reference by its code, or by its name in the standard's table; both with their semicolons
    names = {f"&{k}": v.replace("\xa0", " ") for k, v in html5.items() if k.endswith(";")}
    table = f"MAP([{', '.join(map(_quoted, names))}], [{', '.join(map(_quoted, names.values()))}])"
    cuts = f"regexp_extract_all({plain}, '&#[0-9]+;|&#[xX][0-9a-fA-F]+;|&[A-Za-z][A-Za-z0-9]*;|[^&]+|&')"
    code = "replace(chr(CAST(replace(lower(substr(x, 3, len(x) - 3)), 'x', '0x') AS INTEGER)), chr(160), ' ')"
    plain = f"array_to_string(list_transform({cuts}, lambda x: CASE WHEN x LIKE '&#_%;' THEN {code} ELSE coalesce(names[x], x) END), '')"
    for pattern, by in warc.SPACE_STEPS:
        plain = f"regexp_replace({plain}, {_quoted(pattern)}, {_quoted(by)}, 'g')"
    plain = f"trim({plain}, {_quoted(' ' + chr(10))})"

    def urn(of: str) -> str:
        cuts = " || '-' || ".join(f"substr(md5({of}), {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
        return f"'<urn:uuid:' || {cuts} || '>'"

    http, eol = warc.HTTP_HEADERS, _quoted("\r\n")
    lines = "".join(f"source-http: {line}\r\n" for line in http.splitlines())
    fields = " || ".join([
        "'title: '", r"trim(regexp_replace(regexp_extract(payload, '(?is)<title[^>]*>([^<]*)', 1), '[ \t\r\n\f]+', ' ', 'g'))",
        _quoted("\r\nlanguage: "), """regexp_extract(payload, '(?i)<html[^>]* lang="([^">]*)"', 1)""",
        _quoted("\r\nlinks: "), "CAST(len(regexp_extract_all(payload, '(?i)<a [^>]*href=')) AS VARCHAR)",
        _quoted("\r\ntext-length: "), "CAST(strlen(plain) AS VARCHAR)", _quoted("\r\nsource-payload-digest: "), "digest",
        _quoted("\r\nsource-block-digest: "), f"'sha256:' || sha256({_quoted(http)} || {eol} || payload)",
        _quoted("\r\nsource-payload-length: "), "CAST(strlen(payload) AS VARCHAR)", eol, _quoted(lines), eol,
    ])

    def record(kind: str, content_type: str, block: str) -> str:
        own = urn(f"'{kind}|' || record_id")
        headers = " || ".join([
            _quoted(f"{warc.VERSION}\r\nWARC-Type: {kind}\r\nWARC-Record-ID: "), own, _quoted(f"\r\nWARC-Date: {warc.DATE}"),
            f"coalesce({_quoted(chr(13) + chr(10) + 'WARC-Target-URI: ')} || url, '')", _quoted("\r\nWARC-Refers-To: "), "record_id",
            _quoted("\r\nWARC-Block-Digest: "), f"'sha256:' || sha256({block})",
            _quoted(f"\r\nContent-Type: {content_type}\r\nContent-Length: "), f"CAST(strlen({block}) AS VARCHAR)", eol,
        ])
        return f"SELECT page_id, record_id AS refers_to, digest AS payload_digest, '{kind}' AS warc_type, {own} AS record_id, {headers} AS headers, {block} AS block FROM f"

    response = urn("'response|' || coalesce(CAST(page_id AS VARCHAR), '') || '|' || coalesce(url, '') || '|' || sha256(coalesce(html, ''))")
    return (
        f"WITH refs AS (SELECT {table} AS names), p AS (SELECT page_id, url, coalesce(html, '') AS payload, {response} AS record_id FROM pages), "
        f"q AS (SELECT p.*, 'sha256:' || sha256(payload) AS digest, {plain} AS plain FROM p, refs), f AS (SELECT *, {fields} AS fields FROM q) "
        + record("metadata", "application/warc-fields", "fields") + " UNION ALL " + record("conversion", "text/plain; charset=utf-8", "plain")
    )


def oracle_sql() -> dict[str, str]:
    return {"op1_nn_descent": _VECTORS, "op6_warc": _warc_sql(), "op7_decontaminate": _WINDOWS, "op11_phrases": _PHRASES, "op12_mix": _MIX, "op13_dual_tree": _lloyd_sql()}
