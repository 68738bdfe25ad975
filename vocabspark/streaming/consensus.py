"""Consensus over opinions that arrive in any order within a watermark."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.annotation import OpinionRule

DAY_MS = 86_400_000
NOUN = "struct<noun:string,n:bigint,n_correct:bigint,last_ms:bigint,waiting:array<struct<at:bigint,event_id:bigint,opinion:boolean>>>"


def _needed(rule: OpinionRule, n: int, right: int) -> int:
    c = rule.confidence
    settle = min((c * n - right) / (1 - c), (c * n - (n - right)) / (1 - c), rule.most - n)
    return max(int(np.ceil(settle)), rule.least - n, 0)


def _category(rule: OpinionRule, n: int, right: int) -> str:
    if right / n >= rule.confidence:
        return "correct_primary"
    return "incorrect" if (n - right) / n >= rule.confidence else "close_primary"


class Consensus(StatefulProcessor):
    """Per image, for each noun: the counts of the opinions accepted so far, and those that wait for the watermark.

    Of those waiting only the earliest `most` are held, as no more can ever be accepted. A timer at the
    earliest hands them out in order once nothing earlier can come; another one, `keep_ms` after the last accepted
    opinion, ends a noun's state. All nouns of an image are one value, as a call to the state costs far more than a noun.
    """

    def __init__(self, rule: OpinionRule, keep_ms: int) -> None:
        self.rule, self.keep_ms = rule, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.nouns = handle.getValueState("nouns", f"nouns array<{NOUN}>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        heads: dict[str, list[tuple]] = {}
        for frame in rows:
            news: dict[str, list[tuple]] = {}
            for noun, *opinion in zip(*(frame[c].tolist() for c in ("noun", "at", "event_id", "opinion"))):
                if noun is not None:
                    news.setdefault(noun, []).append(tuple(opinion))
            for noun, some in news.items():
                heads[noun] = heapq.nsmallest(self.rule.most, [*heads.get(noun, []), *some], key=lambda r: r[:2])
        nouns, wake = self._held(), None
        for noun, head in heads.items():
            n, right, last, held = nouns.get(noun, (0, 0, 0, []))
            if _needed(self.rule, n, right) <= 0:
                continue
            nouns[noun] = (n, right, last, heapq.nsmallest(self.rule.most, [*held, *head], key=lambda r: r[:2]))
            if not held or head[0][0] < held[0][0]:
                wake = head[0][0] if wake is None else min(wake, head[0][0])
        if wake is not None or heads:
            self._hold(nouns)
        if wake is not None:
            self._wake(wake)
        return
        yield

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        nouns, out, due, ends = self._held(), [], [], []
        for noun, (before, right, last, held) in list(nouns.items()):
            n = before
            for at, _, opinion in held:
                if at > now * 1000 or _needed(self.rule, n, right) <= 0:
                    break
                n, right, last = n + 1, right + int(opinion), -(-at // 1000)
            left = [r for r in held if r[0] > now * 1000] if _needed(self.rule, n, right) > 0 else []
            nouns[noun] = (n, right, last, left)
            if left:
                due.append(left[0][0])
            if n > before:
                ends.append(last + self.keep_ms)
                out.append((key[0], noun, n, right, _category(self.rule, n, right)))
            elif not left and last + self.keep_ms <= now:
                del nouns[noun]
        self._hold(nouns)
        if due:
            self._wake(min(due))
        for end in set(ends):
            self.handle.registerTimer(end)
        if out:
            yield pd.DataFrame(out, columns=["image", "noun", "n", "n_correct", "category"])

    def close(self) -> None:
        pass

    def _held(self) -> dict[str, tuple]:
        state = self.nouns.get()
        return {r[0]: (r[1], r[2], r[3], [tuple(w) for w in r[4]]) for r in state[0]} if state else {}

    def _hold(self, nouns: dict[str, tuple]) -> None:
        if nouns:
            self.nouns.update(([(noun, *state) for noun, state in nouns.items()],))
        else:
            self.nouns.clear()

    def _wake(self, at: int) -> None:
        self.handle.registerTimer(-(-at // 1000))


def stream_consensus(opinions: DataFrame, rule: OpinionRule, watermark: str = "1 hour", keep_days: int = 3650) -> DataFrame:
    """Consensus per (image, noun), updated while opinions are still needed.

    Opinions count in (ts, event_id) order, each once no earlier one can come by the `watermark`; so
    the rows do not depend on how the input is cut into micro-batches, nor on its order within the watermark.
    Opinions later than that are dropped. The state of a noun ends `keep_days` after its last accepted opinion. Rows without a noun
    are left out.
    """
    timed = opinions.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
    rows = timed.select("image", "noun", "ts", F.unix_micros("ts").alias("at"), "event_id", "opinion")
    return rows.groupBy("image").transformWithStateInPandas(
        Consensus(rule, keep_days * DAY_MS), "image string, noun string, n long, n_correct long, category string", "update", "eventTime"
    )
