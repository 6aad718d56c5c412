"""Abstracts with section labels to Markdown."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

# Section labels.
SECTIONS = (
    "Materials and Methods", "Patients and Methods", "Subjects and Methods", "Design and Methods", "Main Outcome Measures", "Main Outcome Measure", "Primary Outcomes", "Secondary Outcomes", "Primary Outcome", "Secondary Outcome",
    "Data Sources", "Data Source", "Data Extraction", "Data Synthesis", "Data Analysis", "Study Design", "Study Selection", "Study Population", "Statistical Analysis", "Statistical Methods",
    "Clinical Implications", "Clinical Significance", "Key Findings", "Key Results", "Key Messages", "Key Points", "Trial Registration", "What is Known", "What is New", "What This Adds",
    "Practice Implications", "Policy Implications", "Future Directions", "Future Research", "Strengths and Limitations", "Author Summary", "Plain Language Summary", "Lay Summary", "Take Home Message", "Evidence Acquisition", "Evidence Synthesis",
    "Background", "Introduction", "Context", "Rationale", "Purpose", "Objective", "Objectives", "Aim", "Aims", "Hypothesis", "Methods", "Methodology", "Design", "Setting", "Participants", "Patients", "Subjects", "Sample", "Population",
    "Interventions", "Intervention", "Exposure", "Exposures", "Measurements", "Measures", "Outcomes", "Results", "Findings", "Observations", "Analysis", "Discussion", "Interpretation", "Conclusions", "Conclusion",
    "Summary", "Implications", "Significance", "Relevance", "Limitations", "Funding", "Acknowledgements", "Acknowledgments",
)
_LONGEST = sorted(SECTIONS, key=len, reverse=True)
_LABEL = re.compile(rf"\b({'|'.join(map(re.escape, _LONGEST))}):\s*", re.IGNORECASE)
_CAPS = re.compile(rf"\b({'|'.join(s.upper() for s in _LONGEST if ' ' not in s)})\b:?\s*")
_NAMED = {s.lower(): s for s in SECTIONS}


def clean(raw: str) -> str:
    return re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]+>", "", raw))).strip()


def format_abstract(raw: str | None) -> tuple[str, list[str]]:
    """(Markdown, sections) of an abstract: labels in capitals if there are two, else labels with a colon."""
    if not raw or not raw.strip():
        return "[Abstract not available]", []
    text = clean(raw)
    marks = list(_CAPS.finditer(text))
    if len(marks) >= 2:
        names = [m[1].capitalize() for m in marks]
    else:
        marks = list(_LABEL.finditer(text))
        names = [_NAMED[m[1].lower()] for m in marks]
    if not marks:
        return text, []
    ends = [m.start() for m in marks[1:]] + [len(text)]
    lead = text[: marks[0].start()].strip()
    blocks = [lead] if lead else []
    blocks += [f"**{name}**\n{text[m.end():end].strip()}".rstrip() for name, m, end in zip(names, marks, ends, strict=True)]
    return "\n\n".join(blocks), names


def format_abstracts(papers: DataFrame, id_col: str, column: str) -> DataFrame:
    """(id, markdown, sections) of a column of abstracts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [format_abstract(x) for x in batch["text"]]
            yield pd.DataFrame({"id": batch["id"], "markdown": [m for m, _ in made], "sections": [s for _, s in made]})

    return papers.selectExpr(f"CAST({id_col} AS STRING) AS id", f"{column} AS text").mapInPandas(run, "id string, markdown string, sections array<string>")
