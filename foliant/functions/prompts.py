"""Prompts for readers and verifiers as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The prompts' texts.
SINGLE = "You are given an image. Answer the question using only the visual information.\n\nQuestion: {question}\nAnswer:"
OVERVIEW = "You are given one low-resolution overview image followed by high-resolution patches from the same original image. Use the overview for global layout and the patches for small text. Answer the question using only the provided visual information.\n\nQuestion: {question}\nAnswer:"
WITH_OCR = 'You are answering a document question.\n\nUse the provided document image patches and OCR evidence.\nReturn only the final answer.\nDo not explain.\nDo not write a sentence.\nDo not include prefixes like "The answer is".\nIf the answer is a name, number, date, amount, or phrase, output only that exact text.\n\nQuestion:\n{question}\n\nOCR evidence:\n{evidence}\n\nAnswer:'
CHOICE = "You are answering a document question.\n\nQuestion:\n{question}\n\nCandidate answers:\n{options}\n\nLook at the document evidence images.\nChoose the best answer.\nReturn only one letter: {letters}.\n"
BINARY = "You are verifying a candidate answer for a document question.\n\nQuestion:\n{question}\n\nCandidate answer:\n{candidate}\n\nSupporting OCR snippet:\n{evidence}\n\nIs this candidate fully supported by the document evidence and does it answer the question exactly?\nReturn only YES or NO.\n"
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
NONE = "none of the above"


def filled(template: str, **values: Column) -> Column:
    """template with every {name} replaced by its column; values are never read as templates."""
    parts, rest = [], template
    while "{" in rest:
        before, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        parts += [F.lit(before), F.coalesce(values[name].cast("string"), F.lit(""))]
    return F.concat(*parts, F.lit(rest))


def with_ocr(question: Column, lines: Column) -> Column:
    """The prompt with OCR lines as evidence, blank ones left out; (none) if nothing is left."""
    some = F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: x != "")
    return filled(WITH_OCR, question=question, evidence=F.when(F.size(some) > 0, F.array_join(some, "\n")).otherwise("(none)"))


def choices(candidates: Column, none: bool = True) -> Column:
    """Candidates (26 at most with none) by letter, the last letter for NONE if asked for: a map."""
    every = F.concat(candidates, F.array(F.lit("NONE"))) if none else candidates
    return F.map_from_arrays(F.slice(F.array(*[F.lit(x) for x in LETTERS]), F.lit(1), F.size(every)), every)


def choice(question: Column, candidates: Column, none: bool = True) -> Column:
    """The prompt that asks for one letter of choices()."""
    every = F.concat(candidates, F.array(F.lit(NONE))) if none else candidates
    letters = F.array(*[F.lit(x) for x in LETTERS])
    options = F.array_join(F.transform(every, lambda c, i: F.concat(F.element_at(letters, i + 1), F.lit(". "), c)), "\n")
    return filled(CHOICE, question=question, options=options, letters=F.array_join(F.slice(letters, F.lit(1), F.size(every)), "/"))


def binary(question: Column, candidate: Column, evidence: Column) -> Column:
    return filled(BINARY, question=question, candidate=candidate, evidence=F.coalesce(F.nullif(evidence, F.lit("")), F.lit("(none)")))
