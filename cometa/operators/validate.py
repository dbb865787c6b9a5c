"""The audit: one ordered ``CASE WHEN`` per row, built from Column expressions.

Evaluation order (first match wins):

1. note ``L121``                        -> NULL (left to people)
2. empty comment                        -> ``C`` for comment-optional notes, else ``SC``
3. special character                    -> ``UCE``
4. three consecutive spaces             -> ``EE``
5. ``03`` on notes T181/R111            -> ``CFP``
6. only allowed tokens, optional note   -> ``C``
7. note without a rule                  -> ``C``
8. the note's content validator (registry below)

Everything is a pure expression over ``trim_ws(comment)`` and
``trim_ws(nota)``, so the audit is a narrow Project: no shuffle, no Python,
and it runs unchanged on a streaming DataFrame.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cometa.functions.text import (
    DIGIT,
    WS,
    bounded,
    digit_run_count,
    first_digit_run,
    has_digit,
    has_special_char,
    trim_ws,
    words_with_digit_count,
)
from cometa.operators.rules import (
    ALLOWED_TOKENS,
    CODE_03_NOTES,
    COMMENT_OPTIONAL_NOTES,
    MANUAL_NOTE,
    Rule,
    RuleColumns,
    default_rules,
)
from cometa.plans.joins import lookup_join

# ---------------------------------------------------------------------------
# The patterns of the rules.
# ---------------------------------------------------------------------------
# Single-word allowed tokens (a word can never equal a two-word token).
_SINGLE_WORD_TOKENS = [t for t in ALLOWED_TOKENS if " " not in t]
# Bounded occurrences of different tokens never overlap (each one is a whole
# word or word pair), so one alternation pass removes exactly what removing
# them one by one, longest first, removes.
_TOKENS_RE = bounded("|".join(ALLOWED_TOKENS))
_NOTE_CODE_RE = bounded(rf"[A-Z]{DIGIT}{{3}}")
_DEVICE_ID_RE = bounded(rf"[A-Z]{{1,2}}{DIGIT}+")
# Upper-case letters that are not allowed: A-Z and U+00C1..U+00DA.
_LETTER_RE = "[A-ZÁ-Ú]"
_READING_RE = rf"^(103|55){DIGIT}{{1,6}}$"
_READING_PREFIX_RE = "^(103|55)"
# ---------------------------------------------------------------------------


def only_allowed_tokens(c: Column) -> Column:
    """Comment made only of allowed tokens (after upper-casing)."""
    return trim_ws(F.regexp_replace(F.upper(c), _TOKENS_RE, "")) == ""


def has_disallowed_letters(c: Column) -> Column:
    """Letters left after removing note codes, allowed tokens and device ids."""
    t = F.upper(c)
    t = F.regexp_replace(t, _NOTE_CODE_RE, "")
    t = F.regexp_replace(t, _TOKENS_RE, "")
    t = F.regexp_replace(t, _DEVICE_ID_RE, "")
    return t.rlike(_LETTER_RE)


# ---------------------------------------------------------------------------
# Content validators: (features, rule) -> label Column. The comment is
# stripped and non-empty, and has passed the UCE/EE/03 checks.
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Feats:
    """Per-row inputs shared by the validators.

    In the single-expression form (:func:`audit_label`) these are plain
    expressions; in the staged form (:func:`with_audit_label`) they are
    columns computed once per row in a lower projection, which keeps the CASE
    small enough for whole-stage codegen inside aggregations.
    """

    c: Column
    letters: Column
    runs: Column
    first: Column


def raw_feats(c: Column) -> Feats:
    return Feats(c=c, letters=has_disallowed_letters(c), runs=digit_run_count(c), first=first_digit_run(c))


def _meter_reading(f: Feats, rule: Rule | None = None) -> Column:
    return (
        F.when(f.runs == 0, "NI")
        .when(f.letters, "CFP")
        .when(f.runs == 1, F.when(f.first.rlike(_READING_RE), "C").otherwise("FL"))
        .when(f.runs > 8, "CFP")
        .otherwise("C")
    )


def _meter_reading_function(f: Feats, rule: Rule | None = None) -> Column:
    has_function = rule.has_function(f.c) if rule is not None else F.lit(False)
    return F.when(~has_function, "NI").otherwise(_meter_reading(f, rule))


def _pole(f: Feats, rule: Rule | None = None) -> Column:
    without_ids = F.regexp_replace(f.c, rf"(?iu)[SMX]{DIGIT}+", "")
    return (
        F.when(~has_digit(f.c), "NI")
        .when(f.letters & has_disallowed_letters(without_ids), "CFP")
        .when(f.c.rlike(rf"(?iu)[SM]{DIGIT}{{6}}|X{DIGIT}+"), "C")
        .otherwise("CI")
    )


def _matching_text(f: Feats, rule: Rule | None = None) -> Column:
    return F.lit("C")


def _campaign(f: Feats, rule: Rule | None = None) -> Column:
    return F.lit("C")


def _meter_without_reading(f: Feats, rule: Rule | None = None) -> Column:
    u = F.upper(f.c)
    # Per word, keep only ASCII A-Z/0-9; separators survive so words stay apart.
    residue = F.regexp_replace(u, f"[^A-Z0-9{WS}]", "")
    allowed = "|".join(_SINGLE_WORD_TOKENS)
    letters_only_word = rf"(?<![A-Z0-9])(?!(?:{allowed})(?![A-Z0-9]))[A-Z]+(?![A-Z0-9])"
    return (
        F.when(~has_digit(f.c), "NI")
        .when(residue.rlike(letters_only_word), "CFP")
        .when(words_with_digit_count(u) > 8, "CFP")
        .otherwise("C")
    )


def _format(f: Feats, rule: Rule | RuleColumns | None = None) -> Column:
    """Extension content type: the comment matches the rule's own pattern."""
    return F.when(rule.has_format(f.c) if rule is not None else F.lit(False), "C").otherwise("CFP")


def _function_only(f: Feats, rule: Rule | None = None) -> Column:
    return F.when(f.c.rlike(rf"^{DIGIT}{{2}}$"), "C").otherwise("CFP")


def _function_reading(f: Feats, rule: Rule | None = None) -> Column:
    single = (
        F.when(f.first.rlike(_READING_RE), "C")
        .when((F.length(f.first) <= 4) & ~f.first.rlike(_READING_PREFIX_RE), "CI")
        .otherwise("FL")
    )
    return (
        F.when(f.runs == 0, "NI")
        .when(f.letters, "CFP")
        .when(f.runs == 1, single)
        .when(f.runs > 8, "CFP")
        .otherwise("C")
    )


_N, _C, _LETTERS, _RUNS, _FIRST = _STAGED = ["__cm_n", "__cm_c", "__cm_letters", "__cm_runs", "__cm_first"]
_PARAMS = ["funcoes_validas", "funcao_invalida", "formato_especifico"]


def _feats() -> Feats:
    """The staged features."""
    return Feats(c=F.col(_C), letters=F.col(_LETTERS), runs=F.col(_RUNS), first=F.col(_FIRST))


Validator = Callable[[Feats, "Rule | RuleColumns | None"], Column]

VALIDATORS: dict[str, Validator] = {
    "MEDIDOR_LEITURA": _meter_reading,
    "MEDIDOR_LEITURA_FUNCAO": _meter_reading_function,
    "POSTE_FORMAT": _pole,
    "TEXTO_CONDIZENTE": _matching_text,
    "CAMPANHA": _campaign,
    "MEDIDOR_SEM_LEITURA": _meter_without_reading,
    "APENAS_FUNCAO": _function_only,
    "FUNCAO_LEITURA": _function_reading,
    "FORMATO": _format,
}

# Content types whose validators read the shared features (letters / digit
# runs); the staged form computes those features only for their notes.
_USES_FEATS = {"MEDIDOR_LEITURA", "MEDIDOR_LEITURA_FUNCAO", "POSTE_FORMAT", "FUNCAO_LEITURA"}


def register_validator(required: str, builder: Validator, uses_features: bool = True) -> None:
    """Extension point: a new content type for new rule entries."""
    VALIDATORS[required] = builder
    if uses_features:
        _USES_FEATS.add(required)


def content_label(nota: Column, f: Feats, rules: list[Rule] | None = None) -> Column:
    """Dispatch on the note's rule; a note without a rule is conforming.

    Rules sharing a content type and parameters share one branch, so the CASE
    has one arm per distinct validator, not per note.
    """
    rules = rules if rules is not None else default_rules()
    groups: dict[tuple, list[str]] = {}
    for r in rules:
        key = (r.required, r.funcoes_validas, r.funcao_invalida, r.formato_especifico)
        groups.setdefault(key, []).append(r.nota)
    expr = None
    for (required, funcs, invalid, fmt), notes in groups.items():
        rule = Rule(notes[0], required, "", funcs, invalid, fmt)
        builder = VALIDATORS.get(required)
        branch = builder(f, rule) if builder is not None else F.lit("C")
        cond = nota.isin(notes)
        expr = F.when(cond, branch) if expr is None else expr.when(cond, branch)
    return F.lit("C") if expr is None else expr.otherwise("C")


def _label(nota: Column, comment_raw: Column, f: Feats, content: Column) -> Column:
    c = f.c
    empty = comment_raw.isNull() | (c == "")
    optional = nota.isin(COMMENT_OPTIONAL_NOTES)
    code_03 = nota.isin(CODE_03_NOTES) & (c.startswith("03") | c.rlike(bounded("03")))
    return (
        F.when(nota == MANUAL_NOTE, F.lit(None).cast("string"))
        .when(empty, F.when(optional, "C").otherwise("SC"))
        .when(has_special_char(c), "UCE")
        .when(c.contains("   "), "EE")
        .when(code_03, "CFP")
        .when(optional & only_allowed_tokens(c), "C")
        .otherwise(content)
    )


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _norm_nota(nota_raw: Column) -> Column:
    # str(null) is "nan": an unknown note.
    return F.coalesce(trim_ws(nota_raw.cast("string")), F.lit("nan"))


def audit_label(nota_col: Column | str, comment_col: Column | str, rules: list[Rule] | None = None) -> Column:
    """V0 as one Column expression (for ad-hoc use and small inputs).

    Prefer :func:`with_audit_label` on large tables: it computes the shared
    features once per row.
    """
    comment_raw = _col(comment_col)
    nota, f = _norm_nota(_col(nota_col)), raw_feats(trim_ws(comment_raw.cast("string")))
    return _label(nota, comment_raw, f, content_label(nota, f, rules))


def with_audit_label(
    df: DataFrame,
    nota_col: str,
    comment_col: str,
    out_col: str = "analise",
    rules: list[Rule] | None = None,
) -> DataFrame:
    """V0 as staged projections: trimmed text, then shared features (only for
    the notes that read them), then the ordered CASE. Same result as
    :func:`audit_label`; each regex runs at most once per row."""
    rules = rules if rules is not None else default_rules()
    feat_notes = sorted({r.nota for r in rules if r.required in _USES_FEATS})
    staged = _staged(df, nota_col, comment_col, F.col(_N).isin(feat_notes))
    return staged.withColumn(out_col, _label(F.col(_N), F.col(comment_col), _feats(), content_label(F.col(_N), _feats(), rules))).drop(*_STAGED)


def _staged(df: DataFrame, nota_col: str, comment_col: str, uses_features: Column) -> DataFrame:
    """The trimmed note and comment, then the shared features of the rows that read them."""
    staged = df.withColumns({_N: _norm_nota(F.col(nota_col)), _C: trim_ws(F.col(comment_col).cast("string"))})
    c, need = F.col(_C), uses_features & (F.col(_C) != "")
    return staged.withColumns(
        {
            _LETTERS: F.when(need, has_disallowed_letters(c)),
            _RUNS: F.when(need, digit_run_count(c)),
            _FIRST: F.when(need, first_digit_run(c)),
        }
    )


def with_table_rules(df: DataFrame, nota_col: str, comment_col: str, rules: DataFrame, out_col: str = "analise") -> DataFrame:
    """V0 with the rules of a table (see ``rules.RULES_SCHEMA``): each row takes its
    note's content type and parameters by a join, and the content type's validator
    reads the parameters from the row. The plan has one branch a registered content
    type, however many rules there are; the table is broadcast while it is small. A
    note without a rule, or with a content type that no validator has, is conforming.
    A note with two rules ends the job."""
    twice = F.raise_error(F.concat(F.lit("two rules for note "), F.col("nota"))).cast("string")
    own = rules.groupBy(trim_ws(F.col("nota")).alias("nota")).agg(F.count("*").alias("__n"), *[F.first(c).alias(f"__rule_{c}") for c in ["required", *_PARAMS]])
    own = own.withColumn("__rule_required", F.when(F.col("__n") > 1, twice).otherwise(F.col("__rule_required"))).drop("__n")
    joined = lookup_join(df.withColumn("__rule_nota", _norm_nota(F.col(nota_col))), own.withColumnRenamed("nota", "__rule_nota"), "__rule_nota")
    required = F.col("__rule_required")
    staged = _staged(joined, nota_col, comment_col, F.coalesce(required.isin(sorted(_USES_FEATS)), F.lit(False)))
    params = RuleColumns(*[F.col(f"__rule_{c}") for c in _PARAMS])
    content = F.lit("C")
    for name, builder in VALIDATORS.items():
        content = F.when(required == name, builder(_feats(), params)).otherwise(content)
    labelled = staged.withColumn(out_col, _label(F.col(_N), F.col(comment_col), _feats(), content))
    return labelled.drop(*_STAGED, "__rule_nota", *[f"__rule_{c}" for c in ["required", *_PARAMS]])


# ---------------------------------------------------------------------------
# Table-level operators
# ---------------------------------------------------------------------------


def resolve_roles(columns: list[str], legacy_last_match: bool = False) -> tuple[str | None, str | None, str | None]:
    """Find (nota, comment, analysis) columns by name (metadata only).

    The canonical mode takes the first match; ``legacy_last_match`` keeps the
    last match for nota/comment, as the table-level audit historically did.
    """
    nota = comment = analysis = None
    for name in columns:
        low = name.lower()
        if "nota" in low and "leit" in low and (nota is None or legacy_last_match):
            nota = name
        if "coment" in low and (comment is None or legacy_last_match):
            comment = name
        if ("analise" in low or "análise" in low) and analysis is None:
            analysis = name
    return nota, comment, analysis


def audit(
    df: DataFrame,
    comment_col: str | None = None,
    nota_col: str | None = None,
    analysis_col: str = "ANÁLISE",
    rules: list[Rule] | None = None,
    legacy_last_match: bool = False,
) -> DataFrame:
    """Label every row, keeping labels that are already set.

    A non-null analysis value -- even an empty string -- is preserved; only
    null rows get the computed label.
    """
    if nota_col is None or comment_col is None or nota_col not in df.columns or comment_col not in df.columns:
        found_nota, found_comment, _ = resolve_roles(df.columns, legacy_last_match=legacy_last_match)
        if legacy_last_match:
            nota_col, comment_col = found_nota, found_comment
        else:
            nota_col = nota_col if nota_col in df.columns else found_nota
            comment_col = comment_col if comment_col in df.columns else found_comment
    if nota_col is None or comment_col is None:
        raise ValueError(f"note/comment columns not found: nota={nota_col}, comment={comment_col}, columns={df.columns}")
    if analysis_col not in df.columns:
        return with_audit_label(df, nota_col, comment_col, analysis_col, rules)
    tmp = "__cm_label"
    out = with_audit_label(df, nota_col, comment_col, tmp, rules)
    return out.withColumn(analysis_col, F.coalesce(F.col(analysis_col).cast("string"), F.col(tmp))).drop(tmp)


def reset_analysis(df: DataFrame, nota_col: str | None, analysis_col: str = "ANÁLISE") -> DataFrame:
    """P5: keep existing labels only on the manual note; clear everything else."""
    if nota_col is None:
        return df.withColumn(analysis_col, F.lit(None).cast("string"))
    keep = trim_ws(F.col(nota_col).cast("string")) == MANUAL_NOTE
    return df.withColumn(analysis_col, F.when(keep, F.col(analysis_col).cast("string")))


def standardize_analysis(df: DataFrame, analysis_col: str = "ANÁLISE") -> tuple[DataFrame, bool]:
    """Rename the found analysis column to ``analysis_col`` or create it null.

    Returns the frame and whether an analysis column existed.
    """
    _, _, found = resolve_roles(df.columns)
    if found is None:
        return df.withColumn(analysis_col, F.lit(None).cast("string")), False
    if found != analysis_col:
        df = df.withColumnRenamed(found, analysis_col)
    return df, True
