"""Final score: blend of a model's and the heuristic score, with quality multiplier and cap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import even

#: Fixed values.
CONFIDENCE = {"low": 0.35, "medium": 0.6, "high": 0.85}
WEIGHT = {"low": 0.45, "medium": 0.6, "high": 0.75}
VERSION = "hybrid_v2"


def _lookup(column: str, table: dict[str, float]) -> str:
    return f"CASE lower(trim({column})) " + " ".join(f"WHEN '{k}' THEN {v}D" for k, v in table.items()) + f" ELSE {table['low']}D END"


def final_score(rows: DataFrame) -> DataFrame:
    """Adds the final score and its trace to rows(selected_method, ai_score, ai_confidence, heuristic_score, heuristic_confidence,
    heuristic_summary, score_multiplier, score_cap). A multiplier of null or 0 counts as 1."""
    df = rows.withColumns({
        "is_ai": F.expr("coalesce(selected_method = 'ai', false)"), "h_": F.expr("coalesce(heuristic_score, 0D)"), "a_": F.expr("coalesce(ai_score, 0D)"),
        "mult_": F.expr("coalesce(nullif(score_multiplier, 0D), 1D)"), "hc_": F.expr("coalesce(heuristic_confidence, 'low')"), "ac_": F.expr("coalesce(ai_confidence, 'low')"),
    })
    df = df.withColumn("delta_", F.expr("abs(a_ - h_)"))
    weight = f"least(greatest({_lookup('ac_', WEIGHT)} + CASE WHEN delta_ <= 0.15D THEN 0.1D WHEN delta_ >= 0.4D THEN -0.15D ELSE 0D END, 0.35D), 0.85D)"
    df = df.withColumns({"w_": F.expr(weight), "band_": F.expr("CASE WHEN delta_ <= 0.15D THEN 'high' WHEN delta_ <= 0.3D THEN 'medium' ELSE 'low' END")})
    df = df.withColumn("hw_", F.expr(even("1D - w_", 4)))
    base = "CASE WHEN is_ai THEN a_ * w_ + h_ * hw_ ELSE h_ END"
    df = df.withColumn("final_score", F.expr(even(f"CASE WHEN score_cap IS NULL THEN ({base}) * mult_ ELSE least(({base}) * mult_, score_cap) END", 4)))
    mixed = f"({_lookup('ac_', CONFIDENCE)} * w_ + {_lookup('hc_', CONFIDENCE)} * hw_)"
    mixed = f"CASE WHEN band_ = 'low' THEN least({mixed}, 0.68D) ELSE {mixed} END"
    prefix = "CASE WHEN final_score >= 0.7D THEN 'Score hibrido fuerte' WHEN final_score >= 0.45D THEN 'Score hibrido moderado' ELSE 'Score hibrido conservador' END"
    summary = (
        "CASE WHEN NOT is_ai THEN coalesce(nullif(heuristic_summary, ''), 'Score heuristico aplicado por falta de score IA utilizable.')"
        f" WHEN band_ = 'high' THEN concat({prefix}, '; IA y heuristica son consistentes.')"
        f" WHEN a_ > h_ THEN concat({prefix}, '; la IA empuja el score por encima del baseline heuristico.')"
        f" ELSE concat({prefix}, '; la heuristica modera una evaluacion IA mas optimista.') END"
    )
    return df.select(
        *rows.columns, "final_score",
        F.expr(f"CASE WHEN NOT is_ai THEN hc_ WHEN {mixed} >= 0.78D THEN 'high' WHEN {mixed} >= 0.5D THEN 'medium' ELSE 'low' END").alias("final_confidence"),
        F.expr(summary).alias("final_summary"), F.expr("CASE WHEN is_ai THEN 'hybrid' ELSE 'heuristic_only' END").alias("strategy"), F.lit(VERSION).alias("strategy_version"),
        F.expr(f"CASE WHEN is_ai THEN {even('w_', 4)} ELSE 0D END").alias("ai_weight"), F.expr("CASE WHEN is_ai THEN hw_ ELSE 1D END").alias("heuristic_weight"),
        F.expr(f"CASE WHEN is_ai THEN {even('delta_', 4)} END").alias("agreement_delta"), F.expr("CASE WHEN is_ai THEN band_ END").alias("agreement_band"),
    )
