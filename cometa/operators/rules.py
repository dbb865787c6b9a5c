"""The audit rule set as data (one row per note code) plus the registry that
turns each rule's ``required`` content type into a Column builder.

The rule table is a fixed, small dimension (19 notes). It is compiled into a
single ``CASE WHEN`` by :mod:`cometa.operators.validate`; :func:`rules_frame`
exposes the same data as a DataFrame for lookups and reporting (J1).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values (must equal the audited business rules exactly).
# ---------------------------------------------------------------------------

# Audit label alphabet: conform, no comment, special character, excess spaces,
# missing reading, off-pattern, incorrect comment, wrong note.
LABELS = ["C", "SC", "UCE", "EE", "FL", "CFP", "CI", "NI"]
NON_CONFORMING = ["CFP", "SC", "FL", "NI", "EE", "CI", "UCE"]

# Note whose label is left to people (never computed).
MANUAL_NOTE = "L121"

# Allowed stand-alone tokens, in the order they are removed (longest first).
ALLOWED_TOKENS = ["NR DI", "NR RE", "NR IM", "SELO", "ZELO", "S", "R"]

# Notes for which an empty comment (or a comment made only of allowed tokens)
# is conforming.
COMMENT_OPTIONAL_NOTES = ["T161", "L131", "P191", "T171", "L121"]

# Notes checked for the forbidden function code "03".
CODE_03_NOTES = ["T181", "R111"]

# note -> (required content type, description, extra parameters)
RULE_TABLE = [
    ("B111", "MEDIDOR_LEITURA", "Local Cons. Implantado em Duplicidade", {}),
    ("P111", "MEDIDOR_LEITURA", "E.M. Substituído ou Número Incorreto", {}),
    ("P131", "MEDIDOR_LEITURA", "E.M. Vizinho Não Cadastrado", {}),
    ("T171", "MEDIDOR_LEITURA_FUNCAO", "Data/Hora do E.M. Incorreta", {"funcoes_validas": ["01", "02"]}),
    ("E101", "POSTE_FORMAT", "Poste Inclinado ou Quebrado", {}),
    ("E111", "POSTE_FORMAT", "Objeto, Árvore, Imóvel Encostado/Próximo à Rede", {}),
    ("P231", "POSTE_FORMAT", "Iluminação Pública Acesa Durante o Dia", {}),
    ("C111", "TEXTO_CONDIZENTE", "Bairro Incorreto", {}),
    ("C121", "TEXTO_CONDIZENTE", "Rua Incorreta", {}),
    ("C131", "TEXTO_CONDIZENTE", "Número da Porta/Porta Incorreto", {}),
    ("C151", "TEXTO_CONDIZENTE", "Atividade Incorreta", {}),
    ("C161", "TEXTO_CONDIZENTE", "Quant. Incorreta de Dígitos do E.M.", {}),
    ("C181", "TEXTO_CONDIZENTE", "Número do Poste Incorreto", {}),
    ("P191", "TEXTO_CONDIZENTE", "U.C. Vizinha Com Ligação Clandestina", {}),
    ("R161", "TEXTO_CONDIZENTE", "Ponto de Referência Incorreto", {}),
    ("L131", "CAMPANHA", "Campanha 2", {"formato_especifico": "n DO TEL; NOME; VAZIO E RECUSA DE DADOS"}),
    ("R111", "MEDIDOR_SEM_LEITURA", "Medidor Alocado Incorretamente", {}),
    ("T161", "APENAS_FUNCAO", "Função Não Existe no PDA", {}),
    ("T181", "FUNCAO_LEITURA", "Função Não Existe no Sistema", {"funcao_invalida": "03"}),
]
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Rule:
    nota: str
    required: str
    description: str
    funcoes_validas: tuple[str, ...] = ()
    funcao_invalida: str | None = None
    formato_especifico: str | None = None

    def has_function(self, c: Column) -> Column:
        """Whether the comment holds one of the rule's functions (a substring test, not a token test)."""
        found = F.lit(False)
        for fn in self.funcoes_validas:
            found = found | c.contains(fn)
        return found

    def has_format(self, c: Column) -> Column:
        """Whether the rule's pattern matches the comment; a rule without one matches nothing."""
        return c.rlike(self.formato_especifico) if self.formato_especifico else F.lit(False)


@dataclass(frozen=True)
class RuleColumns:
    """A rule's parameters as columns: those of each row's own rule, joined to it."""

    funcoes_validas: Column
    funcao_invalida: Column
    formato_especifico: Column

    def has_function(self, c: Column) -> Column:
        return F.coalesce(F.exists(self.funcoes_validas, lambda fn: c.contains(fn)), F.lit(False))

    def has_format(self, c: Column) -> Column:
        return F.coalesce(F.regexp_like(c, self.formato_especifico), F.lit(False))


def default_rules() -> list[Rule]:
    out = []
    for nota, required, description, params in RULE_TABLE:
        out.append(
            Rule(
                nota=nota,
                required=required,
                description=description,
                funcoes_validas=tuple(params.get("funcoes_validas", ())),
                funcao_invalida=params.get("funcao_invalida"),
                formato_especifico=params.get("formato_especifico"),
            )
        )
    return out


RULES_SCHEMA = T.StructType(
    [
        T.StructField("nota", T.StringType(), False),
        T.StructField("required", T.StringType(), False),
        T.StructField("description", T.StringType(), False),
        T.StructField("funcoes_validas", T.ArrayType(T.StringType()), True),
        T.StructField("funcao_invalida", T.StringType(), True),
        T.StructField("formato_especifico", T.StringType(), True),
    ]
)


def rules_frame(spark: SparkSession, rules: list[Rule] | None = None) -> DataFrame:
    """The rule table as a (tiny, broadcastable) DataFrame."""
    rules = rules if rules is not None else default_rules()
    rows = [
        (r.nota, r.required, r.description, list(r.funcoes_validas) or None, r.funcao_invalida, r.formato_especifico)
        for r in rules
    ]
    return spark.createDataFrame(rows, RULES_SCHEMA)
