"""Independent DuckDB SQL for the ML-preparation and evaluation queries."""

from __future__ import annotations

from cometa.operators.mlprep import SEQUENCE_LENGTH, STAGE2_PREFIX, STAGE2_SEPARATOR, UNK, VOCAB_MAX_TOKENS
from cometa.plans.oracle_audit import AUD_SQL, AUDIT_CTES

DOCS = """
WITH docs AS (
  SELECT d.doc_id, d.source, d.lang, d.text, l.quality, l.toxic,
         'q' || CAST(l.quality AS VARCHAR) || 't' || CAST(l.toxic AS VARCHAR) AS label
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
lab AS (SELECT * FROM docs WHERE label IS NOT NULL)
"""

_STD = (
    "string_split_regex(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    "'[[:punct:]]', '', 'g'), '[ \\t\\n\\v\\f\\r]+')"
)

VOCAB = f"""
, toks AS (SELECT unnest({_STD}) AS token FROM lab),
tc AS (SELECT token, count(*) AS n FROM toks WHERE token <> '' GROUP BY token),
vocab AS (
  SELECT token, n, CAST(row_number() OVER (ORDER BY n DESC, token) + 1 AS INTEGER) AS id FROM tc
  QUALIFY row_number() OVER (ORDER BY n DESC, token) <= {VOCAB_MAX_TOKENS - 2})
"""

_CONF = AUDIT_CTES + """
, conf AS (SELECT analise_previa AS t, v0 AS p, count(*) AS n FROM v
           WHERE analise_previa IS NOT NULL AND v0 IS NOT NULL GROUP BY 1, 2),
bt AS (SELECT t AS label, sum(n) AS support, sum(CASE WHEN t = p THEN n ELSE 0 END) AS tp FROM conf GROUP BY t),
bp AS (SELECT p AS label, sum(n) AS predicted FROM conf GROUP BY p),
j AS (SELECT COALESCE(bt.label, bp.label) AS label, COALESCE(support, 0) AS support, COALESCE(tp, 0) AS tp,
             COALESCE(predicted, 0) AS predicted FROM bt FULL OUTER JOIN bp ON bt.label = bp.label),
m AS (SELECT label, CASE WHEN predicted > 0 THEN CAST(tp AS DOUBLE) / predicted ELSE 0.0 END AS prec,
             CASE WHEN support > 0 THEN CAST(tp AS DOUBLE) / support ELSE 0.0 END AS rec, support, tp FROM j),
rep AS (SELECT *, CASE WHEN prec + rec > 0 THEN 2 * prec * rec / (prec + rec) ELSE 0.0 END AS f1 FROM m)
"""

_PROBS = """
WITH e0 AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS y FROM embeddings),
e AS (SELECT vec_id, list_transform(range(0, 10),
        lambda j: list_sum(list_filter(y, lambda v, i: (i - 1) % 10 = j)) / 0.1) AS x FROM e0),
m AS (SELECT vec_id, x, list_max(x) AS mx FROM e),
ex AS (SELECT vec_id, list_transform(x, lambda v: exp(v - mx)) AS ee FROM m),
p AS (SELECT vec_id, list_transform(ee, lambda v: v / list_sum(ee)) AS p FROM ex),
s AS (SELECT vec_id, CAST(list_position(p, list_max(p)) - 1 AS INTEGER) AS pred_idx,
             list_max(p) AS confidence, list_max(p) < 0.6 AS review FROM p)
"""

# A cross join of records and classes; the Spark side joins counts instead.
CATEGORY_STATISTICS = f"""
WITH r AS (SELECT k, comentario, analise_previa AS c,
    CASE WHEN analise_previa IS NULL THEN -1 ELSE CAST(('0x' || substr(md5(CAST(k AS VARCHAR)), 1, 8))::BIGINT % 5 AS INTEGER) END AS fold
  FROM ({AUD_SQL})),
classes AS (SELECT DISTINCT c AS label FROM r WHERE c IS NOT NULL),
n AS (SELECT comentario, fold, c AS label, count(*) AS n FROM r WHERE c IS NOT NULL GROUP BY ALL),
folds AS (SELECT DISTINCT fold FROM r),
prior AS (SELECT f.fold, l.label, sum(CASE WHEN n.label = l.label THEN n.n ELSE 0 END) / sum(n.n) AS p
  FROM folds f CROSS JOIN classes l JOIN n ON n.fold <> f.fold GROUP BY ALL),
cells AS (SELECT DISTINCT comentario, fold FROM r),
counted AS (SELECT s.comentario, s.fold, l.label, coalesce(sum(CASE WHEN n.label = l.label THEN n.n END), 0) AS hit, coalesce(sum(n.n), 0) AS total
  FROM cells s CROSS JOIN classes l LEFT JOIN n ON n.comentario IS NOT DISTINCT FROM s.comentario AND n.fold <> s.fold GROUP BY ALL)
SELECT r.k, r.fold, t.label, round((t.hit + 10.0 * p.p) / (t.total + 10.0), 9) AS share
FROM r JOIN counted t ON t.comentario IS NOT DISTINCT FROM r.comentario AND t.fold = r.fold JOIN prior p ON p.fold = r.fold AND p.label = t.label
"""

PPMI = f"""
WITH d AS (SELECT row_number() OVER () AS doc, list_filter({_STD}, lambda t: t <> '') AS t FROM documents WHERE text IS NOT NULL),
toks AS MATERIALIZED (SELECT doc, unnest(t) AS token, generate_subscripts(t, 1) AS pos FROM d),
vocab AS (SELECT token FROM (SELECT token, row_number() OVER (ORDER BY count(*) DESC, token) AS place FROM toks GROUP BY token) WHERE place <= 300),
ahead AS (SELECT token, lead(token) OVER w AS one, lead(token, 2) OVER w AS two FROM toks WINDOW w AS (PARTITION BY doc ORDER BY pos)),
near AS (SELECT token AS a, one AS b FROM ahead UNION ALL SELECT token, two FROM ahead),
known AS (SELECT a, b FROM near WHERE a IN (SELECT token FROM vocab) AND b IN (SELECT token FROM vocab)),
n AS (SELECT a, b, count(*) AS n FROM (SELECT a, b FROM known UNION ALL SELECT b, a FROM known) GROUP BY a, b),
own AS (SELECT a, sum(n) AS n FROM n GROUP BY a),
w AS (SELECT n.a AS token, n.b AS other, n.n, ln(n.n::DOUBLE * (SELECT sum(n) FROM n)::DOUBLE / (x.n::DOUBLE * y.n::DOUBLE)) AS ppmi
  FROM n JOIN own x ON x.a = n.a JOIN own y ON y.a = n.b)
SELECT token, other, n, round(ppmi, 6) AS ppmi FROM w WHERE ppmi > 0
"""

ORACLE = {
    "cooccurrence_ppmi": PPMI,
    "word_factors": "SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, CASE WHEN i = j THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS product FROM range(16) a(i) CROSS JOIN range(16) b(j)",
    "category_statistics": CATEGORY_STATISTICS,
    "pending_split": DOCS
    + "SELECT doc_id, CASE WHEN label IS NOT NULL THEN 'train' ELSE 'predict' END AS split FROM docs",
    "class_support": DOCS + "SELECT label, count(*) AS n FROM lab GROUP BY label",
    "rare_class_filter": DOCS
    + "SELECT doc_id, label FROM lab WHERE label IN (SELECT label FROM lab GROUP BY label HAVING count(*) >= 2)",
    "class_weights": DOCS
    + """, kept AS (SELECT * FROM lab WHERE label IN (SELECT label FROM lab GROUP BY label HAVING count(*) >= 2)),
    s AS (SELECT label, count(*) AS n FROM kept GROUP BY label)
    SELECT label, n, round(CAST(sum(n) OVER () AS DOUBLE) / (count(*) OVER () * n), 6) AS weight FROM s""",
    "label_encode": "SELECT doc_id, source, CAST(dense_rank() OVER (ORDER BY source) - 1 AS INTEGER) AS source_idx "
    "FROM documents",
    "encode_unk": DOCS
    + f""", cls AS (SELECT value, CAST(row_number() OVER (ORDER BY value) - 1 AS INTEGER) AS idx
       FROM (SELECT DISTINCT source AS value FROM lab WHERE source IS NOT NULL UNION SELECT '{UNK}'))
    SELECT d.doc_id, d.source, COALESCE(c.idx, (SELECT idx FROM cls WHERE value = '{UNK}')) AS source_idx
    FROM documents d LEFT JOIN cls c ON d.source = c.value""",
    "one_hot": DOCS
    + """, cls AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS idx FROM (SELECT DISTINCT label FROM lab)),
    k AS (SELECT count(*) AS k FROM cls)
    SELECT l.doc_id, l.label,
      list_transform(range(0, (SELECT k FROM k)), lambda i: CASE WHEN i = c.idx THEN 1 ELSE 0 END) AS one_hot
    FROM lab l JOIN cls c ON l.label = c.label""",
    "stratified_split_counts": DOCS
    + """, s AS (SELECT label, count(*) AS nc, CAST(round(count(*) * 0.8) AS BIGINT) AS ntr FROM lab GROUP BY label)
    SELECT label, 'train' AS split, ntr AS n FROM s WHERE ntr > 0
    UNION ALL SELECT label, 'val' AS split, nc - ntr AS n FROM s WHERE nc - ntr > 0""",
    "stage2_text": DOCS
    + f"SELECT doc_id, '{STAGE2_PREFIX}' || label || '{STAGE2_SEPARATOR}' || text AS stage2_text FROM docs",
    "labelled_dropna": DOCS
    + "SELECT doc_id, text, label AS classificacao, CASE WHEN toxic = 1 THEN 'TOX' END AS sigla FROM docs "
    "WHERE text IS NOT NULL AND label IS NOT NULL",
    "vocab_topk": DOCS + VOCAB + "SELECT token, n, id FROM vocab",
    "token_sequence": DOCS
    + VOCAB
    + f""", dt AS (SELECT doc_id, list_filter({_STD}, lambda x: x <> '') AS t FROM lab),
    hd AS (SELECT dt.doc_id, u.token, u.pos FROM dt, unnest(list_slice(dt.t, 1, {SEQUENCE_LENGTH})) WITH ORDINALITY AS u(token, pos)),
    ids AS (SELECT hd.doc_id, list(CAST(COALESCE(vocab.id, 1) AS INTEGER) ORDER BY hd.pos) AS ids
            FROM hd LEFT JOIN vocab ON hd.token = vocab.token GROUP BY hd.doc_id)
    SELECT dt.doc_id, CAST(COALESCE(len(dt.t), 0) AS BIGINT) AS n_tokens,
      list_concat(COALESCE(ids.ids, []::INTEGER[]),
        list_transform(range(0, {SEQUENCE_LENGTH} - COALESCE(len(ids.ids), 0)), lambda x: CAST(0 AS INTEGER))) AS ids
    FROM dt LEFT JOIN ids ON dt.doc_id = ids.doc_id""",
    "embedding_cache_misses": DOCS
    + """, cached AS (SELECT DISTINCT sha256(text) AS k FROM lab WHERE text IS NOT NULL),
    d AS (SELECT sha256(text) AS text_key, count(*) AS n_docs FROM documents WHERE text IS NOT NULL GROUP BY 1)
    SELECT text_key, n_docs FROM d WHERE NOT EXISTS (SELECT 1 FROM cached c WHERE c.k = d.text_key)""",
    "report_by_class": _CONF
    + "SELECT label, round(prec, 6) AS precision, round(rec, 6) AS recall, round(f1, 6) AS f1, "
    "CAST(support AS BIGINT) AS support FROM rep",
    "report_averages": _CONF
    + """SELECT round(CAST(sum(tp) AS DOUBLE) / sum(support), 6) AS accuracy,
      round(avg(prec), 6) AS macro_precision, round(avg(rec), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1,
      round(sum(prec * support) / sum(support), 6) AS weighted_precision,
      round(sum(rec * support) / sum(support), 6) AS weighted_recall,
      round(sum(f1 * support) / sum(support), 6) AS weighted_f1,
      CAST(sum(support) AS BIGINT) AS n FROM rep""",
    "argmax_confidence": _PROBS + "SELECT vec_id, pred_idx, round(confidence, 6) AS confidence, review FROM s",
    "review_queue": _PROBS + "SELECT count(*) FILTER (WHERE review) AS n_review, count(*) AS n_total FROM s",
}
