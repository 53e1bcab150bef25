"""The corpus operators' queries for the driver, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from quarry.llm import bpe

    return bpe.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_suffix_array_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm import repeats

    return repeats.remove(_table(spark, sf_dir, "documents"))


def op3_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm import warc

    return warc.archive(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_information_theoretic_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm import pii

    return pii.report(_table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm import quality_rules

    docs = _table(spark, sf_dir, "documents")
    rules = quality_rules.learn(quality_rules.labelled_sample(docs, _table(spark, sf_dir, "labels")))
    return quality_rules.score(docs, rules)


def op6_two_pass_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm import sharding

    shuffled = sharding.two_pass_shuffle(_table(spark, sf_dir, "documents"), ("doc_id", "text"))
    text = F.coalesce("text", F.lit(""))
    told = shuffled.select(
        "__bucket",
        "__at",
        "doc_id",
        (F.octet_length(text) + sharding.ROW_BYTES).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
    return sharding.deal(told, shuffled, shards=40)


def op7_multi_order_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm import jaccard

    return jaccard.groups(_table(spark, sf_dir, "documents"))


def op8_cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from quarry.llm import packing

    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm import media

    return media.media_columns(_table(spark, sf_dir, "documents"))


def op10_content_defined_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm import cdc

    return cdc.deduplicate(_table(spark, sf_dir, "documents"))


CONTROL = "</s>[INST] ok [/INST]"


def op11_prefix_target_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm import chat

    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-1, 0, "user", CONTROL), (-1, 1, "assistant", CONTROL)], turns.schema)
    return chat.digests(chat.expand(turns.unionByName(more)))


def op12_threshold_algorithm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm import lexical

    return lexical.search(lexical.build(_table(spark, sf_dir, "documents")), _table(spark, sf_dir, "benchmark"))


def op13_merkle_supersteps(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm import merkle

    return merkle.manifest(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_prefix_bpe, op2_suffix_array_repeats, op3_warc_bundles, op4_information_theoretic_pii, op5_quality_rules, op6_two_pass_shuffle, op7_multi_order_jaccard, op8_cost_balanced_packing, op9_media_columns, op10_content_defined_chunks, op11_prefix_target_expansion, op12_threshold_algorithm, op13_merkle_supersteps, pipeline)}

#: Five hexadecimal digits of a SHA-1 are four of base 32.
_BASE32 = "array_to_string(list_transform(range(0,32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(sha1(h), (i // 4) * 5 + 1, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31), 1)), '')"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TERMS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
_ESCAPED = r"regexp_replace({}, '([<\[])(\\*)(\|im_start\|>|\|im_end\|>|\|endoftext\|>|s>|/s>|INST\]|/INST\])', '\1\\\2\3', 'g')"
_HEAD = _ESCAPED.format("replace(replace(role, '%', '%25'), chr(10), '%0A')")
#: CRC-32 of ASCII digits, bit by bit.
_CRC32 = "xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT)), lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END)), 4294967295::UBIGINT)"


def _fields(text: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text)) + ")"


def _tree(name: str, leaves: str) -> str:
    """CTEs of the nodes (tree, pos, h, lvl, n nodes of the level) and of the runs of children (tree, lvl, at of the parent, hs)."""
    return f"""{name}(tree, pos, h, lvl, n) AS ({leaves} UNION ALL SELECT tree, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), lvl + 1, (n + 2) // 3 FROM {name} WHERE n > 1 GROUP BY tree, pos // 3, lvl, n),
    {name}_runs AS (SELECT tree, lvl, pos // 3 AS up, list(h ORDER BY pos) AS hs FROM {name} WHERE n > 1 GROUP BY ALL)"""


def _fold(name: str, tree: str, begin: str) -> str:
    """CTE of what leaves (id, tree, pos, h, sibs) become on their way up, with the siblings met."""
    return f"""{name}(id, tree, pos, h, sibs, lvl) AS ({begin} UNION ALL
      SELECT f.id, f.tree, f.pos // 3, sha256(list_aggregate(list_transform(r.hs, lambda x, i: CASE WHEN i = f.pos % 3 + 1 THEN f.h ELSE x END), 'string_agg', '')),
        f.sibs || coalesce(list_aggregate(list_filter(r.hs, lambda x, i: i <> f.pos % 3 + 1), 'string_agg', ''), ''), f.lvl + 1
      FROM {name} f JOIN {tree}_runs r ON r.tree = f.tree AND r.lvl = f.lvl AND r.up = f.pos // 3)"""


ORACLE: dict[str, str] = {
    "op3_warc_bundles": f"""WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), m AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS first FROM p)
    SELECT page_id, strlen(h) AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM m""",
    "op11_prefix_target_expansion": f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL VALUES (-1, 0, 'user', '{CONTROL}'), (-1, 1, 'assistant', '{CONTROL}')),
    s AS (SELECT *, sum(length('<|im_start|>' || {_HEAD}) + 1 + length({_ESCAPED.format("text")}) + length('<|im_end|>') + 1) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING) AS stop FROM c)
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
      coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
      coalesce(sum(stop) FILTER (role = 'assistant'), 0)::BIGINT AS formatted_chars FROM s GROUP BY conv_id""",
    "op12_threshold_algorithm": f"""WITH d AS (SELECT doc_id, {_TERMS} AS t FROM documents), s AS (SELECT count(*) FILTER (len(t) > 0) AS big_n, sum(len(t))::BIGINT AS big_l FROM d),
    p AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM d) GROUP BY ALL),
    w AS (SELECT term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, s GROUP BY term, big_n),
    q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
    r AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * big_n) // big_l))))::BIGINT AS score FROM q JOIN w USING (term) JOIN p USING (term), s GROUP BY item_id, doc_id)
    SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM r WHERE score > 0 QUALIFY rank <= 10""",
    "op13_merkle_supersteps": f"""WITH RECURSIVE l AS (SELECT doc_id, source, {_fields("text")} AS leaf, CASE WHEN {_CRC32} % 2 = 0 THEN {_fields("replace(text, chr(10), '')")} ELSE {_fields("text")} END AS now FROM documents),
    o AS (SELECT *, row_number() OVER (ORDER BY source NULLS FIRST, doc_id, leaf) AS id, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id, leaf) - 1 AS pos FROM l),
    {_tree("t", "SELECT tree, pos, leaf, 0, count(*) OVER (PARTITION BY tree) FROM o")},
    subroots AS (SELECT tree AS pos, h FROM t WHERE n = 1),
    {_tree("u", "SELECT 0::BIGINT, pos, h, 0, count(*) OVER () FROM subroots")},
    {_fold("f", "t", "SELECT id, tree, pos, now, '', 0 FROM o")},
    g AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY id ORDER BY lvl DESC) = 1),
    {_fold("v", "u", "SELECT id, 0::BIGINT, tree, h, sibs, 0 FROM g")},
    e AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY id ORDER BY lvl DESC) = 1)
    SELECT o.doc_id, o.leaf, s.h AS subroot, r.h AS root, sha256(e.sibs) AS proof_sha256, e.h AS folded_root, e.h = r.h AS verified FROM o JOIN e USING (id) JOIN subroots s ON s.pos = o.tree, u AS r WHERE r.n = 1""",
}


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
