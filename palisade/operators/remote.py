"""Remote judges: calls from Arrow tasks, a bounded number at once, each with a time limit.

A task calls for the rows of a batch concurrently and gives the answers in the rows' order. What fails, answers late or
answers badly becomes an error of its row; a task never fails for it. At most ``concurrency`` calls run in a task, and a
job's tasks at once times that at the provider.
"""

from __future__ import annotations

import asyncio
import io
import json
import math
from collections.abc import Awaitable, Callable, Iterator
from http.client import HTTPException, HTTPResponse
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.matches import PYTHON_BYTES, slices
from .companions import delimit

#: Gives an awaitable answer to a text: a mapping with ``score`` and maybe ``label`` and ``categories``.
Scan = Callable[[str], Awaitable[dict]]
_TYPES = {"score": pa.float64(), "label": pa.string(), "categories": pa.list_(pa.string()), "error": pa.string()}
_DDL = "score double, label string, categories array<string>, error string"
CONCURRENCY, SECONDS, MOST_BYTES = 8, 0.5, 1 << 20


class _Answer(io.BytesIO):
    def makefile(self, *_):
        return self


async def _posted(url: str, body: bytes, headers: dict[str, str]) -> tuple[int, bytes]:
    """Status and body of a POST over a connection of its own, which ends with the call."""
    to = urlsplit(url)
    tls = to.scheme == "https"
    reader, writer = await asyncio.open_connection(to.hostname, to.port or (443 if tls else 80), ssl=tls or None)
    try:
        told = {"Host": to.netloc, "Content-Type": "application/json", "Content-Length": str(len(body)), "Connection": "close"} | headers
        head = f"POST {to.path or '/'}{'?' + to.query if to.query else ''} HTTP/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in told.items())
        writer.write(head.encode() + b"\r\n" + body)
        await writer.drain()
        raw = await reader.read(MOST_BYTES)
        while raw and len(raw) < MOST_BYTES and (more := await reader.read(MOST_BYTES - len(raw))):
            raw += more
    finally:
        writer.close()
    answer = HTTPResponse(_Answer(raw))
    answer.begin()
    return answer.status, answer.read()


def http_guard(
    url: str,
    headers: dict[str, str] | None = None,
    request: Callable[[str], object] = lambda text: {"text": text},
    reply: Callable[[object], dict] = lambda json: json,
) -> Callable[[], Scan]:
    """A judge behind HTTP that gets and gives JSON; any status but 2xx is an error."""

    def load() -> Scan:
        async def scan(text: str) -> dict:
            status, body = await _posted(url, json.dumps(request(text)).encode(), headers or {})
            if not 200 <= status < 300:
                raise HTTPException(f"status {status}")
            return reply(json.loads(body))

        return scan

    return load


def chat_guard(url: str, model: str, prompt: Callable[[str], str], key: str | None = None) -> Callable[[], Scan]:
    """A model behind a chat endpoint. Its answer is the first {...} of what it says: ``label``, and a ``score`` or,
    without one, 0 for benign and 1 else."""

    def reply(answer: dict) -> dict:
        said = (answer.get("choices") or [{}])[0].get("message", {}).get("content") or ""
        begin, end = said.find("{"), said.find("}")
        if begin < 0 or end < begin:
            raise ValueError("no JSON in the answer")
        told = json.loads(said[begin : end + 1])
        label = told.get("label") or "injection"
        score = told.get("score")
        return {"label": label, "score": score if isinstance(score, int | float) else 0.0 if label == "benign" else 1.0}

    def request(text: str) -> dict:
        return {"model": model, "temperature": 0, "messages": [{"role": "user", "content": prompt(text)}]}

    return http_guard(url, {"Authorization": f"Bearer {key}"} if key else None, request, reply)


def _told(answer: object) -> tuple[float, str | None, list[str] | None, None]:
    score = answer.get("score") if isinstance(answer, dict) else None
    if isinstance(score, bool) or not isinstance(score, int | float) or not math.isfinite(score):
        raise ValueError("no score in the answer")
    label, categories = answer.get("label"), answer.get("categories")
    return min(max(float(score), 0.0), 1.0), None if label is None else str(label), None if categories is None else [str(c) for c in categories], None


async def called(scan: Scan, texts: list[str | None], concurrency: int = CONCURRENCY, seconds: float = SECONDS, attempts: int = 1) -> list[tuple]:
    """(score, label, categories, error) for each text, in order; a null text isn't asked about."""
    gate = asyncio.Semaphore(concurrency)

    async def one(text: str | None) -> tuple:
        if text is None:
            return None, None, None, None
        async with gate:
            for left in range(attempts, 0, -1):
                try:
                    return _told(await asyncio.wait_for(scan(text), seconds))
                except TimeoutError:
                    error = "timeout"
                except Exception as e:  # noqa: BLE001  whatever a provider does degrades its row only
                    error = f"{type(e).__name__}: {e}"
                if left == 1:
                    return None, None, None, error

    return await asyncio.gather(*map(one, texts))


def remote_scores(
    rows: DataFrame,
    text: str,
    load: Callable[[], Scan],
    concurrency: int = CONCURRENCY,
    seconds: float = SECONDS,
    attempts: int = 1,
    delimited: bool = True,
    passed: list[str] | None = None,
) -> DataFrame:
    """Adds score, label, categories and error to the rows, or to their columns ``passed``: what isn't asked for needn't go
    through Python. ``load`` makes the provider once per task.

    Texts go out between delimiters made up for each row, so that the judge can tell them from what it is told.
    Null texts get nulls and are not sent; a provider that can't be made is an error of all rows."""
    kept = [c for c in passed or rows.columns if c not in _TYPES]
    made = rows.withColumn("_mark", F.concat(F.lit("<<"), F.replace(F.expr("uuid()"), F.lit("-")), F.lit(">>")))
    sent = F.when(F.col(text).isNotNull(), delimit(F.col(text), F.col("_mark"))) if delimited else F.col(text)
    narrow = made.select(*kept, sent.alias("_sent"))
    names = [*kept, *_TYPES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan, failure = None, None
        try:
            scan = load()
        except Exception as e:  # noqa: BLE001
            failure = f"{type(e).__name__}: {e}"
        for batch in batches:
            # few texts are Python's, and few calls wait, at once
            for at, piece in slices(batch.column(len(kept)), PYTHON_BYTES):
                texts = piece.to_pylist()
                if failure:
                    found = [(None, None, None, failure if t is not None else None) for t in texts]
                else:
                    found = asyncio.run(called(scan, texts, concurrency, seconds, attempts))
                arrays = [pa.array(c, kind) for c, kind in zip(zip(*found, strict=True), _TYPES.values(), strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.slice(at, len(texts)).columns[: len(kept)], *arrays], names)

    return narrow.mapInArrow(run, StructType([*rows.select(*kept).schema.fields, *StructType.fromDDL(_DDL).fields]))


def remote_scorer(load: Callable[[], Scan], **how) -> Callable[[DataFrame], DataFrame]:
    """The ``apply`` of a chain's Scorer."""
    return lambda rows: remote_scores(rows, "text", load, **how)
