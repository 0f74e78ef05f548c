"""Prompts out of declared sections, compiled to native expressions: conditional sections, values and lists as lines, a budget of characters a section."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from ..functions.text import quoted

#: What stands for a missing value, labels of the seller's context by column (with its own stand-in, if any), titles of the planner's rules.
MISSING = "No especificado"
PERSONA = [
    ("Profesion del vendedor", "user_profession", None), ("Tecnologias/servicios del vendedor", "user_technologies", None), ("Propuesta de valor", "user_value_proposition", None),
    ("Casos de exito previos", "user_past_successes", None), ("Metricas o ROI ofrecido", "user_roi_metrics", None), ("Nicho objetivo", "target_niche", "General"), ("Ubicacion objetivo", "target_location", None),
    ("Idioma objetivo", "target_language", None), ("Tamano de empresa objetivo", "target_company_size", None), ("Pains que el vendedor dice resolver", "target_pain_points", None),
    ("Senales de presupuesto deseadas", "target_budget_signals", None),
]
RULES_TITLE = "REGLAS DE IDENTIFICACION DE ENTIDAD DEL ALGORITMO PLANIFICADOR"
RULES_FOR = "Considera fuertemente que es el negocio objetivo directo si cumple:"
RULES_AGAINST = "Identifica como intermediario (agencia), directorio, o blog y BAJA el score si:"


@dataclass(frozen=True)
class Line:
    """One line: a label and a value (text, or a list joined by commas); `empty` stands for a missing value."""

    label: str
    column: str
    is_list: bool = False
    empty: str = MISSING

    def sql(self) -> str:
        if self.is_list:
            value = f"nullif(array_join(filter(transform(coalesce({self.column}, cast(array() AS array<string>)), v -> trim(v)), v -> v <> ''), ', '), '')"
        else:
            value = f"nullif(trim({self.column}), '')"
        return f"concat({quoted(f'- {self.label}: ')}, coalesce({value}, {quoted(self.empty)}))"


@dataclass(frozen=True)
class Items:
    """A title and the items of a list, one a line; nothing if the list is empty."""

    title: str
    column: str

    def sql(self) -> str:
        return f"CASE WHEN size({self.column}) > 0 THEN concat({quoted(self.title)}, '\\n', array_join(transform({self.column}, v -> concat('- ', v)), '\\n')) END"


@dataclass(frozen=True)
class Text:
    """An expression as it is; null leaves it out."""

    value: str

    def sql(self) -> str:
        return self.value


@dataclass(frozen=True)
class Section:
    """Parts under a title, at most `budget` characters; left out where `when` doesn't hold or where no part has anything."""

    title: str | None
    parts: Sequence[Line | Items | Text]
    budget: int | None = None
    when: str | None = None

    def sql(self) -> str:
        body = f"nullif(concat_ws('\\n', {', '.join(p.sql() for p in self.parts)}), '')"
        whole = f"concat({quoted(self.title + chr(10))}, {body})" if self.title else body
        cut = f"substring({whole}, 1, {self.budget})" if self.budget else whole
        return f"CASE WHEN {self.when} THEN {cut} END" if self.when else cut


def template(sections: Sequence[Section], between: str = "\n\n") -> str:
    """One expression for a prompt: its sections that hold anything, in order."""
    return f"concat_ws({quoted(between)}, {', '.join(s.sql() for s in sections)})"


def persona(lists: Sequence[str], title: str | None = None, budget: int | None = None) -> Section:
    """The seller's context; lists: which of its columns are lists."""
    return Section(title, [Line(label, column, column in lists, empty or MISSING) for label, column, empty in PERSONA], budget)


def entity_rules(targets: str = "target_entity_hints", exclusions: str = "exclusion_entity_hints", budget: int | None = None) -> Section:
    """The planner's hints of what is a target and what isn't; left out without hints."""
    return Section(RULES_TITLE, [Items(RULES_FOR, targets), Items(RULES_AGAINST, exclusions)], budget)
