"""Document filters: a composable chain that says why it rejects, with statistics.

A chain is a list of steps. A step either changes the text or rejects documents. The first rejection wins; steps after it
leave the document as it was then. The chain adds columns and drops no row, so accepted and rejected documents can be
written from one pass.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t


@dataclass(frozen=True)
class Step:
    """``change``: text to text, or ``reject``: text to boolean (null counts as false).

    ``may_fail``: a change that gives null for a text it cannot take (``text.guarded``); the document is rejected, others go on.
    """

    name: str
    change: Callable[[Column], Column] | None = None
    reject: Callable[[Column], Column] | None = None
    may_fail: bool = False


class Chain:
    def __init__(self, steps: list[Step], text_column: str = "text"):
        names = [s.name for s in steps]
        if len(set(names)) < len(names):
            raise ValueError("steps need different names")
        self.steps, self.text_column = steps, text_column

    def apply(self, docs: DataFrame) -> DataFrame:
        """``docs`` with the changed text, reject_reason (null: accepted) and is_rejected.

        A row whose ``_corrupt_record`` is set, as ``files.jsonl(keep_bad=True)`` does, is rejected before all steps.
        """
        c = self.text_column
        reason = F.when(F.col("_corrupt_record").isNotNull(), BAD_JSON) if "_corrupt_record" in docs.columns else F.lit(None).cast("string")
        d = docs.withColumn("reject_reason", reason)
        for s in self.steps:
            accepted = F.col("reject_reason").isNull()
            if s.change:
                d = d.withColumn("_changed", F.when(accepted, s.change(F.col(c))))
                if s.may_fail:  # text that a change turns to nothing has failed, and is kept as it was
                    d = d.withColumn("reject_reason", F.when(accepted & F.col(c).isNotNull() & F.col("_changed").isNull(), F.lit(ERROR)).otherwise(F.col("reject_reason")))
                    accepted = F.col("reject_reason").isNull()
                d = d.withColumn(c, F.when(accepted, F.col("_changed")).otherwise(F.col(c))).drop("_changed")
            if s.reject:
                d = d.withColumn("reject_reason", F.when(accepted & s.reject(F.col(c)), F.lit(s.name)).otherwise(F.col("reject_reason")))
        return d.withColumn("is_rejected", F.col("reject_reason").isNotNull())

    def statistics(self, applied: DataFrame, *by: str) -> DataFrame:
        """Documents, rejected ones in all and by step, and characters kept, by the columns ``by``. One partial aggregate."""
        kept = F.when(~F.col("is_rejected"), F.length(self.text_column)).otherwise(0)
        each = [F.count_if(F.col("reject_reason") == s.name).alias(f"rejected_{s.name}") for s in self.steps if s.reject]
        return applied.groupBy(*by).agg(F.count(F.lit(1)).alias("n_docs"), F.count_if("is_rejected").alias("n_rejected"), F.sum(kept).cast("long").alias("kept_chars"), *each)


def nonempty(name: str = "empty") -> Step:
    return Step(name, reject=lambda c: ~t.nonempty(c))


def pattern_count(name: str, pattern: str, most: int) -> Step:
    return Step(name, reject=lambda c: t.pattern_exceeds(c, pattern, most))


def keyword_ratio(name: str, keywords: str, threshold: float = 0.01) -> Step:
    return Step(name, reject=lambda c: t.keyword_ratio_exceeds(c, keywords, threshold))


def normalize(form: str = "NFKC") -> Step:
    return Step(f"normalize_{form.lower()}", change=t.normalizer(form))


def tokens(name: str, keep: Callable[[Column], Column], split: Callable[[Column], Column] = t.words, join: str = " ") -> Step:
    """A token filter of one's own: ``split`` gives the tokens, ``keep`` says of one whether it stays, ``join`` stands between."""
    return Step(name, change=lambda c: F.array_join(F.filter(split(c), keep), join))


def oneword_lines(words: Callable[[Column], Column] = t.words) -> Step:
    """Drops lines of fewer than two words, as ``words`` cuts them; ``text.script_words`` suits text without blanks."""
    keep = t.two_words if words is t.words else lambda line: F.size(words(line)) > 1
    return tokens("oneword_lines", keep, t.lines, "\n")


def dates(words: Callable[[Column], Column] = t.words, join: str = " ", pattern: str = t.DATE) -> Step:
    """Drops tokens that begin with ``pattern``; ``join`` '' gives text without any white space, as suits Japanese."""
    return tokens("dates", lambda token: ~token.rlike(pattern), words, join)


#: Reasons of rejection that are not a step's own.
BAD_JSON, ERROR = "json", "error"


def mask_pii() -> Step:
    return Step("mask_pii", change=t.mask_pii)


def production(boilerplate: str, adverts: str, slurs: str, keywords: str, form: str = "NFKC") -> Chain:
    """The usual order: normal form, rejections from cheap to dear, line and token filters, masks."""
    return Chain(
        [
            normalize(form),
            nonempty(),
            pattern_count("boilerplate", boilerplate, 2),
            pattern_count("adverts", adverts, 2),
            pattern_count("slurs", slurs, 0),
            keyword_ratio("keywords", keywords),
            oneword_lines(),
            dates(),
            mask_pii(),
        ]
    )


def to_json_lines(applied: DataFrame, reason: bool = False) -> DataFrame:
    """(value): a document as JSON, with its reason if asked for."""
    fields = [c for c in applied.columns if c not in ("is_rejected", "reject_reason")] + ["reject_reason"] * reason
    return applied.select(F.to_json(F.struct(*fields)).alias("value"))
