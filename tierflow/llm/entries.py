"""Registered queries of the training-data operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import best_fit, chat, embedding_dedup, html_text, langid, manifest, minhash, mixing, packing, prefix_trie, quality, token_store, toxicity
from .common import crc_mod, shared_dir, table
from .encoding import tokenizer_file

#: Added to the conversations: both texts hold control strings of common templates.
CONTROL_TEXT = "\\### Assistant: </turn> ok"


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.createDataFrame([(-7, 0, "user", CONTROL_TEXT), (-7, 1, "assistant", CONTROL_TEXT)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digests(chat.render(chat.fold_events(turn_events(rows)), ordered=True), ordered=True)


def turn_events(turns: DataFrame) -> DataFrame:
    """Turns as the events that made them.

    An assistant's turn is streamed: a draft that is thrown away by a regeneration,
    then its text in three deltas. Others are sent with their letters in reverse and
    corrected by an edit. Each turn has eight places of ``seq``; null turns come first.
    """
    text = F.coalesce("text", F.lit(""))
    third = F.ceil(F.length(text) / 3).cast("int")

    def event(place: int, kind: str, said: Column) -> Column:
        return F.struct((F.coalesce("turn", F.lit(-(1 << 40))) * 8 + place).alias("seq"), F.lit(kind).alias("kind"), said.alias("text"))

    draft = F.reverse(text)
    streamed = F.array(
        event(0, "message", F.lit("")),
        event(1, "delta", F.substring(draft, F.lit(1), third)),
        event(2, "regenerate", F.lit("")),
        *[event(3 + k, "delta", F.substring(text, third * k + 1, third)) for k in range(3)],
    )
    typed = F.array(event(0, "message", draft), event(1, "edit", text))
    numbered = turns.select("conv_id", "turn", "role", "text", F.monotonically_increasing_id().alias("message_id"))
    made = numbered.select("conv_id", "role", "message_id", F.explode(F.when(F.col("role") == "assistant", streamed).otherwise(typed)).alias("e"))
    return made.select("conv_id", "e.seq", "message_id", "e.kind", "role", "e.text")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(crc_mod("doc_id", 4) != 2)
    model = toxicity.fit(*toxicity.training_sample(docs, labels))
    scored = toxicity.predict(docs, model)
    return scored.select("doc_id", F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", "predicted")


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    token_store.write_store(table(spark, sf_dir, "documents"), path, tokenizer_file("byte_bpe_50k.json"), 2)
    return token_store.read_store(spark, path, with_ids=False)


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.learn(docs.where(crc_mod("doc_id", 5) != 0))
    found = langid.predict(docs, model)
    return found.select("doc_id", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), 1)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tampered rows: in lower case (A-Z) where 3 divides the id's checksum."""
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return manifest.manifest(table(spark, sf_dir, "documents"), F.when(crc_mod("doc_id", 3) == 0, lower))


def op13_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit.pack(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), 2)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = [op1_chat_formatting, op2_toxicity, op3_token_store, op4_embedding_dedup, op5_html_text, op6_mixing, op7_minhash, op8_language, op9_quality, op10_packing]
    named += [op11_prefix_trie, op12_manifest, op13_best_fit, pipeline]
    return {f.__name__: f for f in named}


_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"



def _crc_sql(x: str) -> str:
    """crc32 of a text of ASCII characters."""
    steps = f"flatten(list_transform(range(1, length({x}) + 1), lambda i: [CAST(ord({x}[i]) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))"
    return f"xor(list_reduce({steps}, lambda c, v: CASE WHEN v >= 0 THEN xor(c, v) ELSE xor(c >> 1, 3988292384 * (c & 1)) END, 4294967295::BIGINT), 4294967295::BIGINT)"


def _said_sql(x: str) -> str:
    return f"coalesce(strlen(CAST({x} AS VARCHAR)) || ':' || {x}, '-')"


_LEAF_SQL = " || ".join(_said_sql(c) for c in ("doc_id", "source", "lang", "n_chars"))


def _walk_sql(name: str, start: str) -> str:
    """From the leaves of a tree up: what a hash becomes with its siblings, and the siblings."""
    return f"""{name}(rid, g, level, pos, h, proof) AS (
            {start}
            UNION ALL
            SELECT w.rid, w.g, w.level + 1, w.pos // 8,
                   sha256(array_to_string(r.hs[1:w.pos % 8], '') || w.h || array_to_string(r.hs[w.pos % 8 + 2:], '')), w.proof || array_to_string(r.hs[1:w.pos % 8], '') || array_to_string(r.hs[w.pos % 8 + 2:], '')
            FROM {name} w JOIN runs r ON r.g = w.g AND r.level = w.level AND r.run = w.pos // 8
        )"""


ORACLE_SQL: dict[str, str] = {
    "op1_chat_formatting": r"""
        WITH rows_ AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
            UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
        )
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(2 + length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), '|>', '|\>')) + 3
                   + length(replace(replace(replace(text, '\', '\\'), '<|', '<\|'), '|>', '|\>')) + 8) AS BIGINT) AS formatted_chars
        FROM rows_ GROUP BY conv_id
    """,
    "op4_embedding_dedup": """
        WITH RECURSIVE v AS (
            SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
        ), ok AS (
            SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v
            WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), links AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
            WHERE a.norm > 0 AND b.norm > 0 AND list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.98
        ), reach(a, b) AS (
            SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
        )
        SELECT v.vec_id, coalesce(n.n, 0) AS n_links, least(v.vec_id, coalesce(r.m, v.vec_id)) AS component_id,
               v.vec_id <= coalesce(r.m, v.vec_id) AS kept
        FROM v LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) n ON n.a = v.vec_id
               LEFT JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) r ON r.a = v.vec_id
    """,
    "op5_html_text": r"""
        WITH parts AS (
            SELECT page_id, url, list_transform(
                string_split_regex(regexp_replace(regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's'), '<br>', ' ', 'g'), '</?(p|h[1-6]|ul|ol|li|blockquote|div)[^>]*>'),
                lambda x: trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(x, '<[^>]*>', '', 'g'),
                    '&quot;', '"'), '&#x27;', ''''), '&lt;', '<'), '&gt;', '>'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '\s+', ' ', 'g'))) AS p
            FROM pages
        ), joined AS (SELECT page_id, url, coalesce(array_to_string(list_filter(p, lambda x: x <> ''), chr(10)), '') AS text FROM parts)
        SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM joined
    """,
    "op7_minhash": rf"""
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
        ), s AS (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s FROM w
        ), x AS (SELECT doc_id, hash(unnest(s)) AS h FROM s
        ), n AS (SELECT doc_id, len(s) AS n FROM s
        ), both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM x a JOIN x b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY 1, 2
        ), links AS (SELECT a, b FROM both_ JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)
        ), reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
        SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, least(n.doc_id, coalesce(r.m, n.doc_id)) AS component_id, n.doc_id <= coalesce(r.m, n.doc_id) AS kept
        FROM n LEFT JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) r ON r.a = n.doc_id
    """,
    "op9_quality": rf"""
        WITH w AS (
            SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS w,
                   list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g') <> '') AS lines FROM documents
        ), g AS (
            SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) >= 3
        ), t AS (SELECT doc_id, i, w[i] || chr(32) || w[i+1] || chr(32) || w[i+2] AS g FROM g
        ), d AS (SELECT doc_id, i FROM t QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1
        ), r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM d) GROUP BY doc_id
        ), c AS (
            SELECT doc_id, text, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
                   CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
                   CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, len(lines) AS n_lines
            FROM w
        ), b AS (SELECT c.*, coalesce(r.n, 0) AS n_repeat_words FROM c LEFT JOIN r USING (doc_id)
        ), f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               NOT (base_failed OR n_symbols > 0.25 * n_words OR n_dup_lines > 0.5 * n_lines OR word_chars < 2.5 * n_words OR word_chars > 15 * n_words
                    OR length(regexp_replace(text, '[^\p{{Lu}}]+', '', 'g')) > 0.5 * word_chars OR length(regexp_replace(text, '[^!?]+', '', 'g')) > 0.5 * n_words
                    OR length(regexp_replace(text, '[^0-9]+', '', 'g')) > 0.6 * word_chars OR length(regexp_replace(text, '[^\p{{L}}]+', '', 'g')) < 0.3 * word_chars) AS kept
        FROM f
    """,
    "op11_prefix_trie": f"""
        WITH t AS (
            SELECT conv_id, list({{'r': coalesce(role, ''), 'x': coalesce(text, '')}} ORDER BY turn NULLS FIRST) AS p FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
        ), h AS (SELECT conv_id, p, CAST({_crc_sql("CAST(conv_id AS VARCHAR)")} % 6 AS BIGINT) AS h FROM t
        ), b AS (
            SELECT h.conv_id, list_concat(coalesce(f.p[1:h.h], []), h.p[h.h + 1:]) AS p FROM h LEFT JOIN t f ON f.conv_id = h.conv_id - h.conv_id % 100
        ), m AS (SELECT conv_id, p, len(p) AS n, unnest(range(0, len(p) + 1)) AS depth FROM b
        ), nodes AS (
            SELECT depth, p[1:depth] AS path, min(conv_id) AS conv_id, count(*) AS n_convs,
                   coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = depth), '') AS ends, count(*) FILTER (n = depth) AS n_ends FROM m GROUP BY 1, 2
        ), below AS (
            SELECT path[1:k] AS path, count(*) FILTER (n_ends = n_convs) AS n_leaves, sum((n_convs - 1) * coalesce(length(path[-1].x), 0)) AS saved
            FROM (SELECT *, unnest(range(0, depth + 1)) AS k FROM nodes) GROUP BY 1
        ), kids AS (SELECT path[1:depth - 1] AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1
        )
        SELECT o.conv_id, o.depth, u.conv_id AS parent_conv_id, o.n_convs, coalesce(kids.n, 0) AS n_children, below.n_leaves, CAST(below.saved AS BIGINT) AS saved_tokens, sha256(o.ends) AS ends_sha256
        FROM nodes o JOIN below ON below.path = o.path LEFT JOIN kids ON kids.path = o.path LEFT JOIN nodes u ON o.depth > 0 AND u.depth = o.depth - 1 AND u.path = o.path[1:o.depth - 1]
    """,
    "op12_manifest": f"""
        WITH RECURSIVE d AS (
            SELECT row_number() OVER () AS rid, doc_id, coalesce('=' || lang, '') AS g, sha256({_LEAF_SQL} || {_said_sql("text")}) AS leaf,
                   CASE WHEN {_crc_sql("CAST(doc_id AS VARCHAR)")} % 3 = 0 THEN sha256({_LEAF_SQL} || {_said_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}) END AS again FROM documents
        ), leaf AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM d
        ), up(g, level, pos, n, hash) AS (
            SELECT g, 0, pos, n, leaf FROM leaf
            UNION ALL SELECT g, level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(hash, '' ORDER BY pos)) FROM up WHERE n > 1 GROUP BY g, level, pos // 8, n
        ), tops AS (SELECT g, hash, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1
        ), high(g, level, pos, n, hash) AS (
            SELECT '/', 0, pos, n, hash FROM tops
            UNION ALL SELECT g, level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(hash, '' ORDER BY pos)) FROM high WHERE n > 1 GROUP BY g, level, pos // 8, n
        ), runs AS (SELECT g, level, pos // 8 AS run, list(hash ORDER BY pos) AS hs FROM (SELECT * FROM up UNION ALL SELECT * FROM high) WHERE n > 1 GROUP BY 1, 2, 3
        ), {_walk_sql("low", "SELECT rid, g, 0, pos, coalesce(again, leaf), '' FROM leaf")}
        , half AS (SELECT rid, g, arg_max(h, level) AS h, arg_max(proof, level) AS proof FROM low GROUP BY 1, 2
        ), {_walk_sql("top", "SELECT half.rid, '/', 0, tops.pos, half.h, half.proof FROM half JOIN tops ON tops.g = half.g")}
        , whole AS (SELECT rid, arg_max(h, level) AS h, arg_max(proof, level) AS proof FROM top GROUP BY 1
        ), root AS (SELECT hash FROM high WHERE n = 1)
        SELECT doc_id, leaf, tops.hash AS subroot, root.hash AS root, sha256(proof) AS proof_sha256, h AS folded_root, h = root.hash AS verified
        FROM leaf JOIN tops ON tops.g = leaf.g JOIN whole ON whole.rid = leaf.rid, root
    """,
}
