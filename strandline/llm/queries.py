"""Named queries op1..op10 over the driver's tables."""

from __future__ import annotations

from strandline.llm import ann, embeddings, lm, minhash, mixing, packing, pii, quality, tokens, toxicity
from strandline.session import table

QUERIES: dict = {}
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_COMPONENTS = """walk(x, y) AS (SELECT {id}, {id} FROM {rows} UNION SELECT w.x, l.v FROM walk w JOIN links l ON l.u = w.y),
comp AS (SELECT x AS {id}, min(y) AS component_id FROM walk GROUP BY x)"""
#: Near-duplicates by comparing all pairs. The other operators' models, hashes and searches have no SQL; tests/llm holds brute-force twins.
ORACLE_SQL: dict[str, str] = {
    "op2_minhash_dedup": f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
r AS (SELECT doc_id, len(ws) AS k, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM w), f AS (SELECT doc_id, k, i, x, lead(x, 1) OVER o AS b, lead(x, 2) OVER o AS c, lead(x, 3) OVER o AS d, lead(x, 4) OVER o AS e FROM r WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
t AS (SELECT DISTINCT doc_id, hash(concat_ws(' ', x, b, c, d, e), 1) AS sh, hash(concat_ws(' ', x, b, c, d, e), 2) AS sg FROM f WHERE e IS NOT NULL OR k < 5 AND i = 1), n AS (SELECT doc_id, count(sh) AS n FROM documents LEFT JOIN t USING (doc_id) GROUP BY 1),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM t a JOIN t b ON a.sh = b.sh AND a.sg = b.sg AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT u, v FROM p JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * k >= 75 * (a.n + b.n - k)), {_COMPONENTS.format(id="doc_id", rows="documents")}
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN comp USING (doc_id)""",
    "op7_embedding_dedup": f"""WITH RECURSIVE e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0),
ok AS (SELECT * FROM e WHERE len(list_filter(x, lambda a: a IS NULL OR isnan(a) OR isinf(a))) = 0 AND len(list_filter(x, lambda a: a <> 0)) > 0),
links AS (SELECT a.vec_id AS u, b.vec_id AS v FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= 0.98), {_COMPONENTS.format(id="vec_id", rows="embeddings")}
SELECT vec_id, (SELECT count(*) FROM links WHERE u = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN comp USING (vec_id)""",
}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_token_counts(spark, sf_dir):
    """Words and vocabulary pieces of each whole text."""
    return tokens.count(table(spark, sf_dir, "documents"))


@query
def op2_minhash_dedup(spark, sf_dir):
    """Near-duplicate documents: size of the shingle set, component and whether the document is its representative."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op3_toxicity(spark, sf_dir):
    """Toxicity score of each document."""
    return toxicity.predict(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op4_quality(spark, sf_dir):
    """Quality score of each document."""
    return quality.predict(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op5_pii(spark, sf_dir):
    """Personal data of each document: counts, hash of the pattern spans, all spans."""
    return pii.digest(pii.find(table(spark, sf_dir, "documents").select("doc_id", "text")))


@query
def op6_packing(spark, sf_dir):
    """Pieces of all documents in windows of 1024 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"))


@query
def op7_embedding_dedup(spark, sf_dir):
    """Near-duplicate vectors: direct links, component and representative."""
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


@query
def op8_ann(spark, sf_dir):
    """The 20 nearest found of every twentieth vector."""
    return ann.search(table(spark, sf_dir, "embeddings"))


@query
def op9_lm_score(spark, sf_dir):
    """Log-probabilities of each document, plain and by the filter's model."""
    return lm.score(table(spark, sf_dir, "documents"))


@query
def op10_mixing(spark, sf_dir):
    """Words that the mix takes of each document."""
    return mixing.mix_sources(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
