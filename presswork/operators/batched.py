"""Models that are asked a batch at a time (M5-M7).

A provider's factory makes it once for each task; it is then called once for every `batch` rows, across the batches in which
Spark hands over rows. A call that fails is made again, then row by row; rows without an answer (null or blank) go to the next
provider, again in batches. A row that nobody answers has a null answer. Null texts are asked nobody. What is blank is told by
`blanks`, the characters a blank answer consists of: by default all whitespace.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import bounded_batches

#: A model call: the answers to texts, in order, None where there is none.
Call = Callable[[list[str]], list["str | None"]]


def ask_all(call: Call, texts: list[str], retries: int, blanks: str | None = None) -> list[str | None]:
    """The answers of one provider; what a call can't answer at once is asked again, then text by text."""

    def once(some: list[str]) -> list[str | None]:
        out = list(call(some))
        if len(out) != len(some):
            raise ValueError(f"{len(out)} answers to {len(some)} texts")
        return [a if a is not None and a.strip(blanks) else None for a in out]

    for _ in range(1 + retries):
        try:
            return once(texts)
        except Exception:  # noqa: BLE001 whatever a provider raises, the next try or provider decides
            continue
    if len(texts) == 1:
        return [None]
    return [ask_all(call, [t], 0, blanks)[0] for t in texts]


def answered(rows: DataFrame, text_col: str, providers: list[tuple[str, Callable[[], Call]]], batch: int = 100, retries: int = 1, blanks: str | None = None) -> DataFrame:
    """rows with answer and provider (the name of who gave it). Providers are shown whole texts, of any length.

    Providers are tried in order. Maps rows; nothing is shuffled. Columns named answer or provider raise.
    """
    bounded_batches(rows.sparkSession)
    if {"answer", "provider"} & {c.lower() for c in rows.columns}:
        raise ValueError("rows have a column named answer or provider")
    at = rows.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, Call] = {}

        def give(part: pa.Table) -> Iterator[pa.RecordBatch]:
            texts = part.column(at).to_pylist()
            answers: list[str | None] = [None] * len(texts)
            by: list[str | None] = [None] * len(texts)
            open_ = [i for i, t in enumerate(texts) if t is not None]
            for number, (name, factory) in enumerate(providers):
                if not open_:
                    break
                if number not in made:
                    made[number] = factory()
                for i, answer in zip(open_, ask_all(made[number], [texts[i] for i in open_], retries, blanks), strict=True):
                    if answer is not None:
                        answers[i], by[i] = answer, name
                open_ = [i for i in open_ if answers[i] is None]
            yield from part.append_column("answer", pa.array(answers, pa.string())).append_column("provider", pa.array(by, pa.string())).combine_chunks().to_batches()

        kept: list[pa.RecordBatch] = []
        held = 0
        for some in batches:
            kept.append(some)
            held += some.num_rows
            while held >= batch:
                rows_ = pa.Table.from_batches(kept)
                yield from give(rows_.slice(0, batch))
                kept = rows_.slice(batch).to_batches()
                held -= batch
        if held:
            yield from give(pa.Table.from_batches(kept))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{fields}, answer string, provider string")
