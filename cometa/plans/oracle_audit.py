"""Independent DuckDB SQL for the audit queries (the correctness oracle).

The oracle restates the rules step by step in SQL (allowed tokens removed one
at a time, longest first; words checked with a list filter), while the Spark
side uses fused regexes. DuckDB's RE2 has no lookarounds, so the oracle uses
``\\b``/``\\d``, which are ASCII's alone. The derived table holds accents and
superscripts too; the rows still agree, since no accented letter stands beside a
``03`` or a token there and no non-ASCII decimal digit occurs, and where letters
and digits of every script matter the oracle names the classes (``\\p{L}``,
``²``). Unicode behaviour beyond that is covered by the golden tests.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# The rules restated for the oracle alone, so that a wrong value
# in the engine can't pass on both sides.
# ---------------------------------------------------------------------------
LABELS = ["C", "SC", "UCE", "EE", "FL", "CFP", "CI", "NI"]
NON_CONFORMING = ["CFP", "SC", "FL", "NI", "EE", "CI", "UCE"]
ALLOWED_TOKENS = ["NR DI", "NR RE", "NR IM", "SELO", "ZELO", "S", "R"]
COMMENT_OPTIONAL_NOTES = ["T161", "L131", "P191", "T171", "L121"]
RULE_TABLE = [
    ("B111", "MEDIDOR_LEITURA", "Local Cons. Implantado em Duplicidade"),
    ("P111", "MEDIDOR_LEITURA", "E.M. Substituído ou Número Incorreto"),
    ("P131", "MEDIDOR_LEITURA", "E.M. Vizinho Não Cadastrado"),
    ("T171", "MEDIDOR_LEITURA_FUNCAO", "Data/Hora do E.M. Incorreta"),
    ("E101", "POSTE_FORMAT", "Poste Inclinado ou Quebrado"),
    ("E111", "POSTE_FORMAT", "Objeto, Árvore, Imóvel Encostado/Próximo à Rede"),
    ("P231", "POSTE_FORMAT", "Iluminação Pública Acesa Durante o Dia"),
    ("C111", "TEXTO_CONDIZENTE", "Bairro Incorreto"),
    ("C121", "TEXTO_CONDIZENTE", "Rua Incorreta"),
    ("C131", "TEXTO_CONDIZENTE", "Número da Porta/Porta Incorreto"),
    ("C151", "TEXTO_CONDIZENTE", "Atividade Incorreta"),
    ("C161", "TEXTO_CONDIZENTE", "Quant. Incorreta de Dígitos do E.M."),
    ("C181", "TEXTO_CONDIZENTE", "Número do Poste Incorreto"),
    ("P191", "TEXTO_CONDIZENTE", "U.C. Vizinha Com Ligação Clandestina"),
    ("R161", "TEXTO_CONDIZENTE", "Ponto de Referência Incorreto"),
    ("L131", "CAMPANHA", "Campanha 2"),
    ("R111", "MEDIDOR_SEM_LEITURA", "Medidor Alocado Incorretamente"),
    ("T161", "APENAS_FUNCAO", "Função Não Existe no PDA"),
    ("T181", "FUNCAO_LEITURA", "Função Não Existe no Sistema"),
]
# ---------------------------------------------------------------------------

AUD_SQL = """
SELECT k, nota,
 CASE tpl
  WHEN 0 THEN CAST(a AS VARCHAR(20)) || ' ' || CAST(b AS VARCHAR(20))
  WHEN 1 THEN CAST(a AS VARCHAR(20))
  WHEN 2 THEN ''
  WHEN 3 THEN 'M' || CAST(100000 + a AS VARCHAR(20))
  WHEN 4 THEN 'SELO'
  WHEN 5 THEN '103 03' || CAST(b AS VARCHAR(20))
  WHEN 6 THEN '03 ' || CAST(b AS VARCHAR(20))
  WHEN 7 THEN CAST(a AS VARCHAR(20)) || '.' || CAST(b AS VARCHAR(20))
  WHEN 8 THEN CAST(a AS VARCHAR(20)) || '   ' || CAST(b AS VARCHAR(20))
  WHEN 9 THEN 'cliente nao estava'
  WHEN 10 THEN CAST(a AS VARCHAR(20)) || ' 1 2 3 4 5 6 7 8'
  WHEN 11 THEN '01'
  WHEN 12 THEN NULL
  WHEN 13 THEN 'MV0' || CAST(a AS VARCHAR(20)) || ' NR DI'
  WHEN 14 THEN 'S' || CAST(200000 + b AS VARCHAR(20)) || ' T181 01 ' || CAST(a AS VARCHAR(20))
  WHEN 15 THEN '103' || CAST(b AS VARCHAR(20))
  WHEN 16 THEN 'poste m' || CAST(100000 + a AS VARCHAR(20))
  WHEN 17 THEN 'não há ligação É'
  WHEN 18 THEN CAST(a AS VARCHAR(20)) || ' ² ² ² ² ² ² ² ²'
  WHEN 19 THEN 't181 01 ' || CAST(b AS VARCHAR(20))
  WHEN 20 THEN 'Ó ' || CAST(a AS VARCHAR(20)) || ' ' || CAST(b AS VARCHAR(20))
  ELSE 'poste M' || CAST(100000 + a AS VARCHAR(20)) END AS comentario,
 CASE WHEN nota = 'L121' AND mod(b, 2) = 0 THEN 'C' WHEN nota = 'L121' AND mod(b, 3) = 0 THEN 'OK' WHEN mod(a, 5) = 0 THEN 'NI' ELSE NULL END AS analise_previa
FROM (SELECT l_orderkey * 10 + l_linenumber AS k, l_partkey AS a, l_suppkey AS b,
   mod(l_partkey * 31 + l_suppkey * 7 + l_linenumber, 22) AS tpl,
   CASE mod(l_orderkey, 21) WHEN 0 THEN 'B111' WHEN 1 THEN 'P111' WHEN 2 THEN 'P131' WHEN 3 THEN 'T171'
    WHEN 4 THEN 'E101' WHEN 5 THEN 'E111' WHEN 6 THEN 'P231' WHEN 7 THEN 'C111' WHEN 8 THEN 'C121'
    WHEN 9 THEN 'C131' WHEN 10 THEN 'C151' WHEN 11 THEN 'C161' WHEN 12 THEN 'C181' WHEN 13 THEN 'P191'
    WHEN 14 THEN 'R161' WHEN 15 THEN 'L131' WHEN 16 THEN 'R111' WHEN 17 THEN 'T161' WHEN 18 THEN 'T181'
    WHEN 19 THEN 'L121' ELSE 'Z999' END AS nota
  FROM lineitem) s
"""


def _q(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _remove_tokens(x: str) -> str:
    for tok in sorted(ALLOWED_TOKENS, key=len, reverse=True):
        x = rf"regexp_replace({x}, '\b{tok}\b', '', 'g')"
    return x


def _letters(x: str) -> str:
    r = rf"regexp_replace(upper({x}), '\b[A-Z]\d{{3}}\b', '', 'g')"
    r = _remove_tokens(r)
    r = rf"regexp_replace({r}, '\b[A-Z]{{1,2}}\d+\b', '', 'g')"
    return f"regexp_matches({r}, '[A-ZÁ-Ú]')"


def _notes(required: str) -> str:
    return _q([n for n, req, _ in RULE_TABLE if req == required])


_MEDIDOR = r"""CASE WHEN runs_ = 0 THEN 'NI' WHEN letters_ THEN 'CFP'
      WHEN runs_ = 1 THEN CASE WHEN regexp_matches(first_, '^(103|55)\d{1,6}$') THEN 'C' ELSE 'FL' END
      WHEN runs_ > 8 THEN 'CFP' ELSE 'C' END"""

_RESIDUE = "regexp_replace(w, '[^A-Z0-9]', '', 'g')"

AUDIT_CTES = f"""
WITH aud AS ({AUD_SQL}),
t AS (
  SELECT *, COALESCE({_strip('nota')}, 'nan') AS n_, {_strip('comentario')} AS c_ FROM aud),
f AS (
  SELECT *,
    len(regexp_extract_all(c_, '\\d+')) AS runs_,
    regexp_extract(c_, '(\\d+)', 1) AS first_,
    {_letters('c_')} AS letters_,
    {_letters("regexp_replace(c_, '(?i)[SMX]\\d+', '', 'g')")} AS letters2_,
    {_strip(_remove_tokens('upper(c_)'))} = '' AS tokens_only_,
    string_split_regex(upper(c_), '\\s+') AS words_
  FROM t),
v AS (
  SELECT *, CASE
    WHEN n_ = 'L121' THEN NULL
    WHEN comentario IS NULL OR c_ = '' THEN CASE WHEN n_ IN ({_q(COMMENT_OPTIONAL_NOTES)}) THEN 'C' ELSE 'SC' END
    WHEN regexp_matches(c_, '[^\\p{{L}}\\p{{N}}_\\s]') THEN 'UCE'
    WHEN contains(c_, '   ') THEN 'EE'
    WHEN n_ IN ('T181', 'R111') AND (starts_with(c_, '03') OR regexp_matches(c_, '\\b03\\b')) THEN 'CFP'
    WHEN tokens_only_ AND n_ IN ({_q(COMMENT_OPTIONAL_NOTES)}) THEN 'C'
    WHEN n_ IN ({_notes('MEDIDOR_LEITURA')}) THEN {_MEDIDOR}
    WHEN n_ IN ({_notes('MEDIDOR_LEITURA_FUNCAO')}) THEN
      CASE WHEN NOT (contains(c_, '01') OR contains(c_, '02')) THEN 'NI' ELSE {_MEDIDOR} END
    WHEN n_ IN ({_notes('POSTE_FORMAT')}) THEN
      CASE WHEN NOT regexp_matches(c_, '\\d') THEN 'NI'
           WHEN letters_ AND letters2_ THEN 'CFP'
           WHEN regexp_matches(c_, '(?i)[SM]\\d{{6}}') OR regexp_matches(c_, '(?i)X\\d+') THEN 'C'
           ELSE 'CI' END
    WHEN n_ IN ({_notes('TEXTO_CONDIZENTE')}) THEN CASE WHEN length(c_) < 1 THEN 'CI' ELSE 'C' END
    WHEN n_ IN ({_notes('CAMPANHA')}) THEN 'C'
    WHEN n_ IN ({_notes('MEDIDOR_SEM_LEITURA')}) THEN
      CASE WHEN NOT regexp_matches(c_, '\\d') THEN 'NI'
           WHEN len(list_filter(words_, lambda w: {_RESIDUE} <> ''
                 AND NOT regexp_matches({_RESIDUE}, '[0-9]')
                 AND {_RESIDUE} NOT IN ({_q(ALLOWED_TOKENS)}))) > 0 THEN 'CFP'
           WHEN len(list_filter(words_, lambda w: regexp_matches(w, '[\\d²]'))) > 8 THEN 'CFP'
           ELSE 'C' END
    WHEN n_ IN ({_notes('APENAS_FUNCAO')}) THEN CASE WHEN regexp_matches(c_, '^\\d{{2}}$') THEN 'C' ELSE 'CFP' END
    WHEN n_ IN ({_notes('FUNCAO_LEITURA')}) THEN
      CASE WHEN runs_ = 0 THEN 'NI' WHEN letters_ THEN 'CFP'
           WHEN runs_ = 1 THEN
             CASE WHEN regexp_matches(first_, '^(103|55)\\d{{1,6}}$') THEN 'C'
                  WHEN length(first_) <= 4 AND NOT regexp_matches(first_, '^(103|55)') THEN 'CI'
                  ELSE 'FL' END
           WHEN runs_ > 8 THEN 'CFP' ELSE 'C' END
    ELSE 'C' END AS v0
  FROM f),
r AS (
  SELECT k, nota, comentario, COALESCE(CASE WHEN n_ = 'L121' THEN analise_previa END, v0) AS analise FROM v)
"""

_RULES_VALUES = ", ".join(f"({_q([n])}, {_q([req])}, {_q([desc])})" for n, req, desc in RULE_TABLE)
_BADGE_COLS = ", ".join(f"count(*) FILTER (WHERE analise = '{lbl}') AS \"{lbl}\"" for lbl in LABELS)
_BADGE_UNNEST = " UNION ALL ".join(f"SELECT '{lbl}' AS label, \"{lbl}\" AS n FROM b" for lbl in LABELS)

# The pre-checks of every note, then the custom rules of ``audit_custom_rules`` as a CASE.
CUSTOM = AUDIT_CTES.split("v AS (")[0] + f"""
v AS (
  SELECT k, nota, comentario, CASE
    WHEN n_ = 'L121' THEN NULL
    WHEN comentario IS NULL OR c_ = '' THEN CASE WHEN n_ IN ({_q(COMMENT_OPTIONAL_NOTES)}) THEN 'C' ELSE 'SC' END
    WHEN regexp_matches(c_, '[^\\p{{L}}\\p{{N}}_\\s]') THEN 'UCE'
    WHEN contains(c_, '   ') THEN 'EE'
    WHEN n_ IN ('T181', 'R111') AND (starts_with(c_, '03') OR regexp_matches(c_, '\\b03\\b')) THEN 'CFP'
    WHEN tokens_only_ AND n_ IN ({_q(COMMENT_OPTIONAL_NOTES)}) THEN 'C'
    WHEN n_ = 'Z999' THEN CASE WHEN regexp_matches(c_, '^\\d+ \\d+$') THEN 'C' ELSE 'CFP' END
    WHEN n_ = 'R161' THEN CASE WHEN regexp_matches(c_, '^poste [mM]\\d{{6}}$') THEN 'C' ELSE 'CFP' END
    WHEN n_ = 'C111' THEN {_MEDIDOR}
    WHEN n_ = 'T171' THEN CASE WHEN NOT (contains(c_, '7') OR contains(c_, '55')) THEN 'NI' ELSE {_MEDIDOR} END
    ELSE 'C' END AS analise FROM f)
SELECT k, nota, comentario, analise FROM v"""

ORACLE = {
    "audit_custom_rules": CUSTOM,
    "audit_rows": AUDIT_CTES + "SELECT k, nota, comentario, v0 AS analise FROM v",
    "audit_preserve": AUDIT_CTES
    + "SELECT k, nota, comentario, analise_previa, COALESCE(analise_previa, v0) AS analise FROM v",
    "audit_reset": AUDIT_CTES + "SELECT k, nota, comentario, analise FROM r",
    "audit_special_chars": AUDIT_CTES
    + "SELECT k, comentario, COALESCE(regexp_matches(c_, '[^\\p{L}\\p{N}_\\s]'), false) AS flag FROM v",
    "audit_excess_space": AUDIT_CTES + "SELECT k, comentario, COALESCE(contains(c_, '   '), false) AS flag FROM v",
    "audit_token_only": AUDIT_CTES + "SELECT k, comentario, COALESCE(tokens_only_, false) AS flag FROM v",
    "audit_letters": AUDIT_CTES + "SELECT k, comentario, COALESCE(letters_, false) AS flag FROM v",
    "audit_number_count": AUDIT_CTES
    + "SELECT k, comentario, CAST(COALESCE(runs_, 0) AS BIGINT) AS digit_runs, COALESCE(first_, '') AS first_run FROM v",
    "audit_poste": AUDIT_CTES + f"SELECT k, nota, comentario, v0 AS analise FROM v WHERE nota IN ({_notes('POSTE_FORMAT')})",
    "audit_medidor": AUDIT_CTES
    + "SELECT k, nota, comentario, v0 AS analise FROM v WHERE nota IN ('B111', 'P111', 'P131', 'T171')",
    "audit_funcao": AUDIT_CTES + "SELECT k, nota, comentario, v0 AS analise FROM v WHERE nota IN ('T161', 'T181')",
    "audit_sem_leitura": AUDIT_CTES + "SELECT k, nota, comentario, v0 AS analise FROM v WHERE nota IN ('R111')",
    "rules_join": f"WITH aud AS ({AUD_SQL}) SELECT k, nota, rl.required, rl.description FROM aud "
    f"LEFT JOIN (VALUES {_RULES_VALUES}) rl(nota_key, required, description) ON {_strip('nota')} = rl.nota_key",
    "label_distribution": AUDIT_CTES + "SELECT analise, count(*) AS n FROM r WHERE analise IS NOT NULL GROUP BY analise",
    "audit_totals": AUDIT_CTES
    + "SELECT count(*) AS total_rows, count(analise) AS filled_rows, "
    "count(*) FILTER (WHERE analise IS NULL) AS empty_rows FROM r",
    "note_label_crosstab": AUDIT_CTES
    + "SELECT nota, analise, count(*) AS n FROM r WHERE nota IS NOT NULL AND analise IS NOT NULL GROUP BY nota, analise",
    "worst_notes": AUDIT_CTES
    + "SELECT nota, count(*) AS n_nonconforming FROM r WHERE nota IS NOT NULL AND analise IS DISTINCT FROM 'C' "
    "GROUP BY nota ORDER BY n_nonconforming DESC, nota LIMIT 10",
    "conformity_kpi": AUDIT_CTES
    + f""", kp AS (SELECT count(*) FILTER (WHERE analise = 'C') AS total_c,
      count(*) FILTER (WHERE analise IN ({_q(NON_CONFORMING)})) AS total_nonconforming FROM r)
    SELECT total_c, total_nonconforming,
      CASE WHEN total_c > 0 THEN CAST(total_nonconforming AS DOUBLE) / total_c * 100 END AS ratio_pct,
      CASE WHEN total_c > 0 THEN replace(printf('%.2f%%', CAST(total_nonconforming AS DOUBLE) / total_c * 100), '.', ',')
           WHEN total_nonconforming = 0 THEN '0,0%' ELSE 'N/A' END AS ratio_text
    FROM kp""",
    "label_badges": AUDIT_CTES
    + f", b AS (SELECT {_BADGE_COLS} FROM r), u AS ({_BADGE_UNNEST}) "
    "SELECT label, n, replace(format('{:,}', n), ',', '.') AS n_text FROM u",
    "fill_and_merge": AUDIT_CTES
    + "SELECT k, nota, comentario, analise_previa AS analise, 'kept' AS origin FROM v WHERE analise_previa IS NOT NULL "
    "UNION ALL SELECT k, nota, comentario, v0 AS analise, 'filled' AS origin FROM v WHERE analise_previa IS NULL",
}
