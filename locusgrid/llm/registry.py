"""The queries of this subpackage, and DuckDB SQL for those that it can say: the n-gram join, the vector join and the archives. The others
are held in tests/llm against brute force, an exact round trip or held-out accuracy: SQL has no tokenizer, model, bootstrapping, sliding
entropy or byte-wise removal, or not the canonical words of templates."""

from __future__ import annotations

from locusgrid.llm import decontaminate, embeddings, licenses, ngram_join, packing, pii, secrets, suffixes, toxicity, warc


def queries():
    return {
        "op1_pii": pii.op1,
        "op2_packing": packing.op2,
        "op3_ngram_jaccard": ngram_join.op3,
        "op4_embeddings": embeddings.op4,
        "op5_secrets": secrets.op5,
        "op6_warc": warc.op6,
        "op7_licenses": licenses.op7,
        "op8_suffixes": suffixes.op8,
        "op9_toxicity": toxicity.op9,
        "op10_decontamination": decontaminate.op10,
    }


#: Smallest node that each node reaches over the edges (a, b) of `links`, which holds both directions.
REACH = """reach(node, dest) AS (SELECT DISTINCT a, a FROM links UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.dest),
component AS (SELECT node, min(dest) AS component FROM reach GROUP BY node)"""

ORACLE = {
    "op3_ngram_jaccard": rf"""WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0) t),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
links AS (SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM grams x JOIN grams y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2) p
    JOIN sizes s ON s.doc_id = p.a JOIN sizes t ON t.doc_id = p.b WHERE 100 * p.k >= 80 * (s.n + t.n - p.k)),
{REACH}
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, coalesce(c.component, d.doc_id) AS component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN component c ON c.node = d.doc_id""",
    "op4_embeddings": f"""WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
sound AS (SELECT vec_id, e FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM sound x JOIN sound y ON x.vec_id <> y.vec_id AND len(x.e) = len(y.e) WHERE list_cosine_similarity(x.e, y.e) >= 0.95),
{REACH}
SELECT v.vec_id, (SELECT count(*) FROM links l WHERE l.a = v.vec_id) AS n_links, coalesce(c.component, v.vec_id) AS component_id, coalesce(c.component, v.vec_id) = v.vec_id AS kept
FROM v LEFT JOIN component c ON c.node = v.vec_id""",
    "op6_warc": """SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN strlen(html) >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN strlen(html) >= 100 AND page_id <> first THEN first END AS refers_to
FROM (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first FROM (SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS digest FROM pages) p) q""",
}


def oracle_sql() -> dict[str, str]:
    return ORACLE
