"""The queries of this subpackage: each applies one operator, with its production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, collocations, divergence, language_id, mixing, multiset_hash, ngram_lm, passages, simhash, token_count, training_order, voronoi_topk
from .common import fold, table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text, learned from the texts and labels outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 4) == 2
    languages, logs = language_id.fit(docs.filter(~held_out))
    return language_id.predict(docs.select("doc_id", held_out.alias("held_out"), "text"), languages, logs, keep=["doc_id", "held_out"])


def op2_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every piece of every document went: its sequence's slot, and its place in the shard files."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # 50256 is no rank of the file
    return training_order.materialised(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, key=42, end=50_256).pieces


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, formatted and read back from the formatted text."""
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = "\\### Assistant: </turn> ok"
    added = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(control).alias("text"),
    )
    return chat.read_back(chat.format_conversations(given.unionByName(added)))


OP3_SQL = r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
    UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), moved AS (
    SELECT *, row_number() OVER w - 1 AS turn_no, lag(role) OVER w AS last_role, count(*) OVER (PARTITION BY conv_id) AS n
    FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), judged AS (
    SELECT *,
        CASE WHEN turn_no = 0 THEN role IN ('system', 'user')
             WHEN role = 'user' THEN last_role IN ('system', 'assistant')
             WHEN role = 'assistant' THEN last_role = 'user'
             ELSE false END AS allowed,
        length(text) + length(regexp_replace(text, '[^\\#:<]', '', 'g')) AS text_chars
    FROM moved
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn_no)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn_no) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum(length('### ' || CASE role WHEN 'system' THEN 'System' WHEN 'user' THEN 'User' ELSE 'Assistant' END || ': ') + text_chars + 8)::BIGINT AS formatted_chars,
    coalesce(min(turn_no) FILTER (NOT allowed), CASE WHEN last(role ORDER BY turn_no) = 'system' THEN count(*) END) IS NULL AS valid,
    coalesce(min(turn_no) FILTER (NOT allowed), CASE WHEN last(role ORDER BY turn_no) = 'system' THEN count(*) END, -1)::BIGINT AS first_error
FROM judged GROUP BY conv_id
"""


def op4_voronoi_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best other vectors by integer inner product for each vector whose id is divisible by 100."""
    return voronoi_topk.top_k(table(spark, sf_dir, "embeddings"), id_col="vec_id", vector_col="embedding", every=100, k=10)


OP4_SQL = """
WITH whole AS (
    SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.r AS r, q.vec_id AS query_id, d.vec_id AS vec_id, list_sum(list_transform(list_zip(q.v, d.v), lambda z: z[1] * z[2]))::BIGINT AS score
    FROM whole q JOIN whole d ON q.vec_id % 100 = 0 AND d.r <> q.r AND len(d.v) = len(q.v)
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM scored
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 10
"""


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of whole texts and the components of links within two bits."""
    found = simhash.groups(table(spark, sf_dir, "documents").select("doc_id", "text"), width=3, budget=2)
    fingerprint = F.concat(*[F.substring(F.hex("sketch"), 2 * i + 1, 2) for i in range(7, -1, -1)])
    return found.select(F.col("id").alias("doc_id"), F.lower(fingerprint).alias("fingerprint"), "component_id")


def op6_multiset_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of whole texts and of their edited texts, and their likeness to the edited and to the next text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    paired = multiset_hash.with_next(docs, "doc_id", "text", {"fp": multiset_hash.fingerprint(F.col("text"))})
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next")["text"], F.lit(1), cut))
    paired = paired.select("doc_id", "fp", n.cast("long").alias("n_chars"), edited.alias("edited"), F.col("next")["fp"].alias("next_fp"))
    paired = paired.withColumn("edited_fp", multiset_hash.fingerprint(F.col("edited")))
    return paired.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited"), 256).alias("edited_sha256"),
        multiset_hash.as_text(F.col("fp")).alias("fingerprint"),
        multiset_hash.as_text(F.col("edited_fp")).alias("edited_fingerprint"),
        multiset_hash.likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        multiset_hash.likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of whole texts, as the SentencePiece library gives them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    counted = token_count.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=["doc_id", "n_bytes"])
    return counted.withColumn("over_limit", F.col("n_tokens") > 4096)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts to ids and back, with digests of both."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = bpe.encode(docs, path, public_tokenizers.PATTERN, keep=["doc_id"], decoded="decoded")
    return both.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op9_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all whole texts under the model of all words, pairs and triples of the training fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = fold(F.col("doc_id"), 7) == 2
    words = ngram_lm.words_of(docs.filter(~held_out))
    ids = ngram_lm.indexed(docs.withColumn("held_out", held_out), words, keep=["doc_id", "held_out"])
    model = ngram_lm.with_levels(ids.filter("NOT held_out"), words, least=1)
    return ngram_lm.score_indexed(ids, model, keep=["doc_id", "held_out"])


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the words that the mix takes of each."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies", "source")


OP10_SQL = r"""
WITH RECURSIVE sized AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
        (('0x' || substr(md5('20|' || coalesce(doc_id::VARCHAR, '~') || '|' || coalesce(text, '')), 1, 13))::BIGINT::DOUBLE + 0.5)
            / 4503599627370496.0 AS u
    FROM documents
), sources AS (
    SELECT source, sum(size)::BIGINT AS source_size, 3.0::DOUBLE * sum(size)::DOUBLE AS stop,
        ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight
    FROM sized GROUP BY source
), levels AS (
    SELECT *, (sum(source_size::DOUBLE) OVER () - coalesce(sum(stop) OVER (ORDER BY stop / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (ORDER BY stop / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
    FROM sources
), targets AS (
    SELECT source, source_size, least(stop, (SELECT arg_min(level, (stop / weight, source)) FROM levels WHERE level * weight <= stop) * weight) AS target
    FROM levels
), parts AS (
    SELECT *, floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END)::BIGINT AS whole,
        CASE WHEN source_size > 0 THEN target / source_size - floor(target / source_size) ELSE 0 END AS p
    FROM targets
), ranked AS (
    SELECT sized.*, source_size, target, whole, p, target - whole * source_size AS budget,
        CASE WHEN p > 0 THEN (u / (1 - u)) * ((1 - p) / p) / (1 + (u / (1 - u)) * ((1 - p) / p)) ELSE 1 END AS v
    FROM sized JOIN parts ON sized.source IS NOT DISTINCT FROM parts.source
), ordered AS MATERIALIZED (
    SELECT *, row_number() OVER (PARTITION BY source ORDER BY v, doc_id NULLS FIRST, size) AS place FROM ranked WHERE p > 0
), walk AS (
    SELECT source, 0::BIGINT AS place, target - whole * source_size AS gap, 0.001::DOUBLE * target AS near, false AS taken_in FROM parts WHERE p > 0
    UNION ALL
    SELECT o.source, o.place, CASE WHEN o.size <= w.gap AND w.gap > w.near THEN w.gap - o.size ELSE w.gap END, w.near,
        o.size = 0 OR (o.size <= w.gap AND w.gap > w.near)
    FROM walk w JOIN ordered o ON o.source IS NOT DISTINCT FROM w.source AND o.place = w.place + 1
), gaps AS (
    SELECT source, min(gap) AS gap FROM walk GROUP BY source
), chosen AS (
    SELECT ordered.*, taken_in FROM ordered JOIN walk ON ordered.source IS NOT DISTINCT FROM walk.source AND ordered.place = walk.place
), last_in AS (
    SELECT chosen.source, arg_min(chosen.place, (abs(size - gap), v, doc_id, size)) AS place
    FROM chosen JOIN gaps ON chosen.source IS NOT DISTINCT FROM gaps.source
    WHERE NOT taken_in AND abs(size - gap) < gap GROUP BY chosen.source
), counted AS (
    SELECT chosen.doc_id, chosen.size, chosen.source_size, chosen.target, chosen.source,
        whole + CASE WHEN taken_in OR last_in.place IS NOT NULL THEN 1 ELSE 0 END AS copies
    FROM chosen LEFT JOIN last_in ON chosen.source IS NOT DISTINCT FROM last_in.source AND chosen.place = last_in.place
    UNION ALL SELECT doc_id, size, source_size, target, source, whole FROM ranked WHERE p = 0
)
SELECT doc_id, size, source_size, target, (size * copies)::BIGINT AS taken, copies::BIGINT AS copies, source FROM counted
"""


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a language's sources, and the terms that a source uses more than its language."""
    return divergence.divergence(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH docs AS (
    SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM documents
), words AS (
    SELECT d, lang, source, unnest(terms) AS term FROM docs
), kept AS (
    SELECT lang, term, count(*)::HUGEINT AS lang_count FROM words GROUP BY lang, term HAVING count(DISTINCT d) >= 30
), counted AS (
    SELECT lang, source, term, count(*)::HUGEINT AS count FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL
), groups AS (
    SELECT lang, source, coalesce(v, 0) AS v, coalesce(lang_n, 0) AS lang_n, coalesce(n, 0) AS n
    FROM (SELECT DISTINCT lang, source FROM docs)
    LEFT JOIN (SELECT lang, count(*)::HUGEINT AS v, sum(lang_count)::HUGEINT AS lang_n FROM kept GROUP BY lang) USING (lang)
    LEFT JOIN (SELECT lang, source, sum(count)::HUGEINT AS n FROM counted GROUP BY ALL) USING (lang, source)
), shares AS (
    SELECT g.lang, source, term, coalesce(c.count, 0) AS count,
        1 + 1000000000 * (coalesce(c.count, 0) + 5) // (n + 5 * v) AS p, 1 + 1000000000 * (lang_count + 5) // (lang_n + 5 * v) AS q
    FROM groups g JOIN kept USING (lang) LEFT JOIN counted c USING (lang, source, term)
), pairs AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, 0::HUGEINT AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source WHERE a.v = 0
    UNION ALL
    SELECT a.lang, a.source, 'pair', b.source, sum(abs(a.p - b.p)) FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), rows AS (
    SELECT * FROM pairs UNION ALL SELECT lang, source, 'term', term, p - q FROM shares WHERE count > 0 AND p > q
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM rows
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""


def op12_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every whole text without the passages of 50 bytes that an earlier document holds too."""
    left = passages.without_repeats(table(spark, sf_dir, "documents"))
    return left.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's best phrases of two and three words."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH pieces AS (
    SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (
        SELECT coalesce(lang, 'und') AS lang,
            unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
        FROM documents)
), starts AS (
    SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces
), counts AS (
    SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*)::HUGEINT AS f
    FROM starts, (VALUES (1), (2), (3)) AS widths(k) WHERE i + k - 1 <= len(w) GROUP BY ALL
), totals AS (
    SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE k = 1 GROUP BY lang
), found AS (
    SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE k > 1 AND f >= 10
), cuts AS (
    SELECT lang, phrase, a, 1 AS cut, w[1] AS head, array_to_string(w[2:], ' ') AS tail FROM found
    UNION ALL SELECT lang, phrase, a, 2, array_to_string(w[:2], ' '), w[3] FROM found WHERE k = 3
), scored AS (
    SELECT cuts.lang, cuts.phrase, a, cut, x.f AS l, y.f AS r, 1000000 * a * a // (x.f * y.f) AS score
    FROM cuts LEFT JOIN counts x ON x.lang = cuts.lang AND x.phrase = head LEFT JOIN counts y ON y.lang = cuts.lang AND y.phrase = tail
), lowest AS (
    SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), longer AS (
    SELECT lang, phrase, max(a) AS longest
    FROM (SELECT lang, unnest([array_to_string(w[:2], ' '), array_to_string(w[2:], ' ')]) AS phrase, a FROM found WHERE k = 3) GROUP BY ALL
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
    FROM lowest LEFT JOIN longer USING (lang, phrase) WHERE longest IS NULL OR 100 * longest < 50 * a
)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_training_order": op2_training_order,
    "op3_chat_formatting": op3_chat_formatting,
    "op4_voronoi_topk": op4_voronoi_topk,
    "op5_simhash": op5_simhash,
    "op6_multiset_fingerprints": op6_multiset_fingerprints,
    "op7_token_counts": op7_token_counts,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_ngram_lm": op9_ngram_lm,
    "op10_source_mixing": op10_source_mixing,
    "op11_source_divergence": op11_source_divergence,
    "op12_repeated_passages": op12_repeated_passages,
    "op13_phrase_collocations": op13_phrase_collocations,
}
ORACLES = {
    "op3_chat_formatting": OP3_SQL,
    "op4_voronoi_topk": OP4_SQL,
    "op10_source_mixing": OP10_SQL,
    "op11_source_divergence": OP11_SQL,
    "op13_phrase_collocations": OP13_SQL,
}
