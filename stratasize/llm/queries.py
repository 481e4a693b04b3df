"""One query for each operator, with production parameters over whole tables, and SQL where it can say the same."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratasize.llm import language_id
from stratasize.llm.common import shared_dir, table
from stratasize.llm.exact_dedup import exact_dedup
from stratasize.llm.html_text import extract
from stratasize.llm.line_dedup import drop_repeated_lines
from stratasize.llm.mixing import mix
from stratasize.llm.neighbours import nearest
from stratasize.llm.packing import pack
from stratasize.llm.sharding import shard_documents
from stratasize.llm.simhash import near_duplicates
from stratasize.llm.spelling import group_variants
from stratasize.llm.substring_dedup import remove_repeats
from stratasize.llm.token_files import checksums, read_tokens, write_tokens
from stratasize.llm.vector_codes import compress


def held_out() -> Column:
    """Rows that language models don't learn from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs.where(~held_out()))
    found = language_id.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", F.round("first_time", 9).alias("first_time"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    write_tokens(table(spark, sf_dir, "documents"), path)
    return checksums(read_tokens(spark, path))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_repeated_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), with_ids=False)


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shard_documents(table(spark, sf_dir, "documents"))
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    return rows.select("doc_id", "size", crc.alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = compress(table(spark, sf_dir, "embeddings"))
    return codes.select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_variants(table(spark, sf_dir, "documents")).select("word", "n", "n_near", "form", "form_n", "root")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_mixing": op2_mixing,
    "op3_token_files": op3_token_files,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_line_dedup": op5_line_dedup,
    "op6_neighbours": op6_neighbours,
    "op7_html_text": op7_html_text,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_simhash": op9_simhash,
    "op10_packing": op10_packing,
    "op11_sharding": op11_sharding,
    "op12_vector_codes": op12_vector_codes,
    "op13_spelling_variants": op13_spelling_variants,
}


def _crc32(x: str) -> str:
    """The CRC of a text's UTF-8 bytes; needs the table `crc`."""
    codes = f"list_transform(regexp_extract_all(hex(encode({x})), '..'), lambda h: ('0x' || h)::BIGINT)"
    return f"xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], {codes}), lambda a, b: xor(a >> 8, tb[xor(a & 255, b) + 1])))"


#: The remainders of all bytes, from the reversed polynomial (a fixed value).
_CRC_TABLE = "crc AS MATERIALIZED (SELECT list(c ORDER BY i) AS tb FROM (SELECT i, list_reduce(list_concat([i], range(8)), lambda a, x: CASE WHEN a & 1 = 1 THEN xor(3988292384, a >> 1) ELSE a >> 1 END) AS c FROM (SELECT unnest(range(256)) AS i)))"


def _vector_codes(rounds: int = 4) -> str:
    """Every assignment compares all entries, unlike the operator."""
    dist = "list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c)"
    steps = []
    for k in range(rounds + 1):
        steps.append(f"a{k} AS MATERIALIZED (SELECT vec_id, label, p, x, min(({dist})::BIGINT * 256 + e) AS m FROM parts JOIN b{k} USING (p) GROUP BY ALL)")
        if k < rounds:
            steps.append(f"""s{k} AS (SELECT p, m % 256 AS e, i, floor(sum(y) / count(*)) AS f FROM (SELECT p, m, unnest(x) AS y, generate_subscripts(x, 1) AS i FROM a{k}) GROUP BY ALL),
                n{k} AS (SELECT p, e, list(f ORDER BY i) AS c FROM s{k} GROUP BY ALL), b{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(n{k}.c, b{k}.c) AS c FROM b{k} LEFT JOIN n{k} USING (p, e))""")
    return f"""
        WITH v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        parts AS MATERIALIZED (SELECT vec_id, label, p, list_slice(v, p * (len(v) // 4) + 1, (p + 1) * (len(v) // 4))::DOUBLE[] AS x FROM v, (SELECT unnest(range(4)) AS p)),
        first AS (SELECT vec_id FROM v ORDER BY vec_id LIMIT 256), b0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM parts SEMI JOIN first USING (vec_id)),
        {", ".join(steps)},
        coded AS MATERIALIZED (SELECT vec_id, label, string_agg(printf('%02x', m % 256), '' ORDER BY p) AS code, sum(m // 256)::BIGINT AS error FROM a{rounds} GROUP BY ALL),
        sums AS (SELECT label, sum(error)::BIGINT AS label_error FROM coded GROUP BY label),
        books AS (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda y: y::BIGINT), ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{rounds})
        SELECT vec_id, code, error, label_error, codebooks_sha256 FROM coded JOIN sums ON coded.label IS NOT DISTINCT FROM sums.label, books"""

ORACLE_SQL: dict[str, str] = {
    "op2_mixing": r"""
        WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5(coalesce(doc_id::VARCHAR, '')) AS key FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
        w AS (SELECT *, (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 AS kind FROM s),
        l AS (SELECT *, [5.0, 2.0, 1.0][kind + 1]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS cap FROM w),
        c AS (SELECT *, (sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM l),
        v AS (SELECT arg_min(level, cap / weight) AS level FROM c WHERE level * weight <= cap),
        t AS (SELECT source, source_size, kind, least(cap, v.level * weight) AS target FROM c, v),
        p AS (SELECT d.*, source_size, kind, target, round(target)::BIGINT AS goal, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id NULLS FIRST, size
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS place FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
        q AS (SELECT *, least(greatest(goal - place, 0), size) + least(greatest(goal - place - source_size, 0), size) AS taken, place / nullif(goal, 0)::DOUBLE AS x FROM p)
        SELECT doc_id, size::BIGINT AS size, source_size, target, taken::BIGINT AS taken, round(CASE WHEN taken > 0 THEN CASE
            WHEN kind = 0 AND x <= 0.6 / 0.88 THEN x * 0.88
            WHEN kind = 0 THEN 0.6 + 2 * (x * 0.88 - 0.6) / (1 + sqrt(1 - 3 * (x * 0.88 - 0.6)))
            WHEN kind = 1 THEN 2 * x / (0.8 + sqrt(0.64 + 0.8 * x))
            WHEN kind = 2 AND x <= 0.35 / 1.05 THEN 2 * (x * 1.05) / (0.4 + sqrt(0.16 + 2.4 * (x * 1.05)))
            ELSE 0.5 + 2 * (x * 1.05 - 0.35) / (1 + sqrt(1 + 3.2 * (x * 1.05 - 0.35))) END END::DOUBLE, 9) AS first_time
        FROM q""",
    "op4_substring_dedup": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        s AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20),
        r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(ws[i:i + 19], ' ') ORDER BY doc_id, i) AS nth FROM s),
        gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM r WHERE nth > 1),
        word AS (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS i FROM w),
        kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
        SELECT doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
        FROM w LEFT JOIN kept USING (doc_id)""",
    "op8_exact_dedup": r"""
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
        g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
        SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(norm) AS text_sha256
        FROM t JOIN g USING (norm)""",
    "op11_sharding": f"""
        WITH {_CRC_TABLE}, d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 16 AS size, {_crc32("coalesce(text, '')")} AS text_crc32 FROM documents, crc),
        p AS (SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING)::BIGINT AS e, sum(size) OVER ()::BIGINT AS whole FROM d),
        s AS (SELECT *, least((2 * e - size) * 40 // (2 * whole), 39)::INTEGER AS shard FROM p)
        SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST) - 1 AS slot, NULL::INTEGER AS grown_shard FROM s""",
    "op12_vector_codes": _vector_codes(),
    "op13_spelling_variants": f"""
        WITH RECURSIVE {_CRC_TABLE}, r AS MATERIALIZED (SELECT coalesce(doc_id::VARCHAR, '') AS d, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
        h AS (SELECT run, {_crc32("d || ':' || run")} AS h FROM (SELECT * FROM r WHERE length(run) >= 7), crc),
        w AS (SELECT CASE WHEN h % 31 = 0 THEN run[1:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word FROM h),
        v AS MATERIALIZED (SELECT word, count(*) AS n FROM w WHERE length(word) >= 7 GROUP BY 1 HAVING count(*) >= 2),
        less AS MATERIALIZED (SELECT word, i, word[1:i - 1] || word[i + 1:] AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v)),
        near AS (SELECT a.word AS a, b.word AS b FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
            UNION SELECT less.word, v.word FROM less JOIN v ON rest = v.word UNION SELECT v.word, less.word FROM less JOIN v ON rest = v.word),
        best AS (SELECT a AS word, count(*) AS n_near, min({{'minus': -n, 'form': b}}) AS best FROM near JOIN v ON b = word GROUP BY 1),
        f AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.minus >= 10 * n THEN best.form END AS form, CASE WHEN -best.minus >= 10 * n THEN -best.minus END AS form_n FROM v LEFT JOIN best USING (word)),
        up AS (SELECT word, form AS root, 1 AS step FROM f WHERE form IS NOT NULL UNION ALL SELECT up.word, f.form, step + 1 FROM up JOIN f ON up.root = f.word WHERE f.form IS NOT NULL)
        SELECT word, n, n_near, form, form_n, coalesce((SELECT arg_max(up.root, step) FROM up WHERE up.word = f.word), word) AS root FROM f""",
}
