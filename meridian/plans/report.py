"""Reports: small result frames as Markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame


def table(df: DataFrame) -> str:
    """All rows as a Markdown table, read partition by partition."""
    show = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v).replace("|", "\\|").replace("\n", " ")
    rows = [df.columns, ["---"] * len(df.columns), *([show(v) for v in r] for r in df.toLocalIterator())]
    return "\n".join("| " + " | ".join(r) + " |" for r in rows)


def report(title: str, parts: dict[str, DataFrame]) -> str:
    """A heading and a table for each part."""
    return "\n\n".join([f"# {title}", *(f"## {name}\n\n{table(df)}" for name, df in parts.items())]) + "\n"


def selection_report(decided: DataFrame, run: str) -> str:
    """Summary, gate failures and ranked candidates of a selection run."""
    from meridian.operators.selection import decision_summary, gate_histogram

    ranked = decided.select("decision_rank", "candidate_id", "decision", "score").orderBy("decision_rank")
    return report(f"Selection {run}", {"Summary": decision_summary(decided), "Failed gates": gate_histogram(decided).orderBy("gate"), "Candidates": ranked})
