"""Re-rendering of finished utterances: a chain of stages, each checked by itself."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import inverse_normalise, keeps_other_words, written_cardinals

#: Words of the utterance before that a stage gets as context.
CONTEXT_WORDS = 6


def plain_words(text: str) -> list[str]:
    """Lower-cased words; whatever is no letter, digit or apostrophe parts them."""
    return "".join(c if c.isascii() and (c.isalnum() or c == "'") else " " for c in text.lower()).split()


@dataclass(frozen=True)
class Stage:
    """apply(text, context) gives a new text; the chain keeps it if verify(before, after) holds. A stage is skipped
    where something that it adds is there already."""

    name: str
    order: int
    adds: frozenset[str]
    apply: Callable[[str, str], str]
    verify: Callable[[str, str], bool]


def punctuation(restore: Callable[[str], str]) -> Stage:
    """Marks and capitals from a function of lower-cased words; the context goes in front and comes off again."""

    def apply(text: str, context: str) -> str:
        lead = context.split()[-CONTEXT_WORDS:]
        return " ".join(restore(" ".join([*lead, *text.split()]).lower()).split()[len(lead) :])

    return Stage("punctuation", 10, frozenset({"punctuation", "casing"}), apply, lambda a, b: plain_words(a) == plain_words(b))


def _digits(text: str, context: str) -> str:
    return inverse_normalise(text)


NUMBERS = Stage("numbers", 90, frozenset({"digits"}), _digits, keeps_other_words)
#: Cardinals only: no dates, percents or money.
CARDINALS = Stage("cardinals", 90, frozenset({"digits"}), lambda text, context: written_cardinals(text), keeps_other_words)


@dataclass(frozen=True)
class Rendered:
    """A text on its way through the stages: what is in it by now, and who was turned down."""

    text: str
    present: frozenset[str]
    rejected: tuple[str, ...]

    def through(self, stage: Stage, context: str) -> Rendered:
        if not stage.adds.isdisjoint(self.present):
            return self
        offer = _offer(stage, self.text, context)
        if offer is None:
            return replace(self, rejected=(*self.rejected, stage.name))
        return self if offer == self.text else replace(self, text=offer, present=self.present | stage.adds)


def _offer(stage: Stage, text: str, context: str) -> str | None:
    """A stage's text, or None where it fails or its own check doesn't hold."""
    try:
        new = stage.apply(text, context)
        return new if new == text or stage.verify(text, new) else None
    except Exception:  # noqa: BLE001  one stage must not take the utterance with it
        return None


@dataclass
class Chain:
    """Stages by their order. A stage that raises or fails its check leaves the text as it was."""

    stages: tuple[Stage, ...] = (NUMBERS,)
    present: frozenset[str] = frozenset()

    def run(self, text: str, context: str = "") -> tuple[str, list[str]]:
        """The text and the names of the stages that were turned down."""
        if not text.strip():
            return text, []
        begin = Rendered(text, self.present, ())
        end = reduce(lambda now, stage: now.through(stage, context), sorted(self.stages, key=lambda s: s.order), begin)
        return end.text, list(end.rejected)


def polish_udf(chain: Chain):
    """(text, context) to text and rejected."""

    @F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("rejected", T.ArrayType(T.StringType()))]))
    def run(text: pd.Series, context: pd.Series) -> pd.DataFrame:
        done = [chain.run(t or "", c or "") for t, c in zip(text, context, strict=True)]
        return pd.DataFrame({"text": [d[0] for d in done], "rejected": [d[1] for d in done]})

    return run
