"""Prompts as Columns, so that a table of requests becomes a table of prompts, and the parts of a prompt again."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STRINGS = 'Answer with a JSON list of strings and nothing else, such as ["read the file", "count its lines"].'
STEPS = 'Answer with a JSON list of objects {"text": string, "expected_tools": integer} and nothing else.'
ASKED = "Ask for nothing that the request leaves out."


def _areas(lines: Column) -> Column:
    """A dash and a line for each capability area."""
    listed = F.array_join(F.transform(lines, lambda x: F.concat(F.lit("- "), x)), "\n")
    return F.when(F.coalesce(F.size(lines), F.lit(0)) > 0, listed).otherwise(F.lit("(no schema provided)"))


def _prompt(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p, F.lit("")) for p in parts])


def decompose(query: Column, areas: Column) -> Column:
    return _prompt("Split the request into short requests that one tool can serve each.\nTools exist for:\n", _areas(areas), f"\n\nA request that one tool can serve stays as it is. {ASKED} {STRINGS}\n\nUser query: ", query, "\nJSON:")


def plan(query: Column, areas: Column) -> Column:
    return _prompt("Split the request into steps and say how many tools each needs: 1 where a step is atomic.\nTools exist for:\n", _areas(areas), f"\n\n{ASKED} {STEPS}\n\nUser query: ", query, "\nJSON:")


def with_dependencies(query: Column, areas: Column) -> Column:
    hints = "Add what a step silently needs: the current date and time for words such as today or now, a new UUID for a new identifier. Conversions, hashes and checks are requests of their own."
    return _prompt("Split the request into short requests that one tool can serve each.\nTools exist for:\n", _areas(areas), f"\n\n{hints} {ASKED} {STRINGS}\n\nUser query: ", query, "\nJSON:")


def candidates(ranked: Column, most: int = 5) -> Column:
    """Lines of the first candidates (name, score, doc): the doc on one line and cut to 120 characters."""

    def line(c: Column) -> Column:
        doc = F.replace(F.trim(F.coalesce(c["doc"], F.lit(""))), F.lit("\n"), F.lit(" "))
        doc = F.when(F.length(doc) > 120, F.concat(F.rtrim(F.substring(doc, 1, 119)), F.lit("..."))).otherwise(doc)
        return F.concat(F.lit("- "), c["name"], F.format_string(" (%.3f)", c["score"]), F.when(doc == "", "").otherwise(F.concat(F.lit(" - "), doc)))

    lines = F.array_join(F.transform(F.slice(ranked, 1, most), line), "\n")
    return F.when(F.coalesce(F.size(ranked), F.lit(0)) > 0, lines).otherwise(F.lit("(no candidates)"))


def refine(step: Column, expected: Column, reason: Column, ranked: Column, areas: Column) -> Column:
    return _prompt(
        "Rewrite one step that found no clear tool: split it if it hides several tools, else name the operation plainly. An empty list means that no tool can serve it.\nTools exist for:\n",
        _areas(areas), "\n\nStep: ", step, "\nTools expected: ", expected.cast("string"), "\nProblem: ", reason, "\nFound so far:\n", candidates(ranked),
        f"\n\nThe expected tools must add up to the step's. {ASKED} {STEPS}\nJSON:",
    )


def describe(members: Column, neighbours: Column) -> Column:
    """Members and neighbours are blocks of lines, the latter empty where the label is to stand alone."""
    return _prompt("Describe in one line what the members have in common and the neighbours have not.\n\nMEMBERS:\n", members, "\n\nNEIGHBORS:\n", neighbours, "\n\nDESCRIPTION:\n")


def enrich(name: Column, signature: Column, doc: Column) -> Column:
    return _prompt(
        "Describe a tool for search. Answer with one JSON object of intent_phrase, input_kind, output_kind, synonyms (a list) and example_queries (a list), and nothing else.\n\nNAME: ",
        name, "\nSIGNATURE: ", signature, "\nDOC: ", doc, "\nJSON:",
    )


def capture(prompt: Column, pattern: str) -> Column:
    """The first group of the pattern without blanks around it; null where it does not match."""
    return F.when(F.regexp_like(prompt, F.lit(pattern)), F.trim(F.regexp_extract(prompt, pattern, 1)))


def block(prompt: Column, header: str) -> Column:
    """What follows the header, up to the next line that is three capitals or more and a colon; empty without the header."""
    at = F.instr(prompt, header)
    tail = F.substring(prompt, at + F.lit(len(header)), F.length(prompt))
    return F.when(at > 0, F.regexp_extract(tail, r"(?s)\A(.*?)(?:\n[A-Z_]{3,}:\n|\z)", 1)).otherwise(F.lit(""))


#: Names of the ways to answer a query; of several flags set, the first counts.
MODES = ("dependency_hinted_decompose", "refined_decompose", "recursive_decompose", "decompose")


def mode(flags: set[str]) -> str:
    """The mode of a set of flags: those of MODES, and pattern_inject, which counts only with decompose."""
    for m in MODES:
        if m in flags:
            return "decompose_pattern_inject" if m == "decompose" and "pattern_inject" in flags else m
    return "direct"
