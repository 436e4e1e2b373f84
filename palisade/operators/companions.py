"""Tool calls, taint, canaries, prompt assembly, spotlighting, request gates."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..config import Policy
from ..functions import regexlib as rx
from ..functions.scoring import bound, enforced, hard_block, reason, reasons, score_of, would_verdict
from .containment import containment

MARKER = "\ue000"
#: Characters of a mark that the automaton holds, and of all marks that go to all tasks.
BEGINNING, MOST_CHARS = 64, 4 << 20


def tool_allowed(calls: DataFrame, allow: DataFrame, name: str = "name") -> DataFrame:
    """Adds allowed: whether the tool's name is in ``allow``."""
    known = allow.select(F.col(name).alias("_allowed")).distinct()
    return calls.join(known, calls[name] == F.col("_allowed"), "left").withColumn("allowed", F.col("_allowed").isNotNull()).drop("_allowed")


def tool_verdict(allowed: Column, tainted: Column, found: Column, policy: Policy) -> Column:
    """struct(reasons, score, verdict) of a tool call: a name that isn't allowed blocks; otherwise the reasons found in its
    arguments, and one for arguments that hold untrusted data, at high risk."""
    stopped = reasons(reason("agentic_tool_hijack", "semantic", F.lit(1.0)))
    folded = F.when(tainted, F.concat(found, reasons(reason("tainted_data_flow", "semantic", F.lit(0.9))))).otherwise(found)
    all_found = F.when(allowed, folded).otherwise(stopped)

    def judged(x: Column) -> Column:
        would = would_verdict(score_of(x), hard_block(x, policy.hard_block_rules), policy, F.lit(True))
        return F.struct(x.alias("reasons"), score_of(x).alias("score"), enforced(would, policy.mode).alias("verdict"))

    return bound(all_found, judged)


def taint_matches(
    docs: DataFrame, marks: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, mark_seq, source): marks (mark_seq, text, source) that a document contains.

    Up to MOST_CHARS characters of marks go to all tasks: one pass over the texts, without a shuffle, in which an
    automaton of the marks' beginnings finds these in a text and the whole mark is compared there. More marks are
    joined by their rarest grams (see containment.py). Null and empty marks and texts meet nothing; repeated rows and
    marks give their rows again.
    """
    marks = marks.where("length(text) > 0").select("mark_seq", "text", "source")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("length(text) > 0")
    size = marks.agg(F.sum(F.length("text").cast("long") + 64)).first()[0] or 0
    if size > MOST_CHARS:
        return containment(texts, marks).select("doc.doc_id", "mark.mark_seq", "mark.source")
    arrow = [to_arrow_type(marks.schema[c].dataType) for c in ("mark_seq", "source")]
    kinds = [x.simpleString() for x in (texts.schema["doc_id"].dataType, marks.schema["mark_seq"].dataType, marks.schema["source"].dataType)]
    sent = docs.sparkSession.sparkContext.broadcast([tuple(r) for r in marks.collect()])  # MOST_CHARS at most
    return texts.mapInArrow(_marks_in(sent, arrow), "doc_id {}, mark_seq {}, source {}".format(*kinds))


def _marks_in(sent, kinds: list[pa.DataType]):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton, by_beginning = ahocorasick.Automaton(), {}
        for seq, mark, source in sent.value:
            by_beginning.setdefault(mark[:BEGINNING], []).append((seq, mark, source))
        for beginning, marks in by_beginning.items():
            automaton.add_word(beginning, (len(beginning), marks))
        if not by_beginning:
            return
        automaton.make_automaton()
        for batch in batches:
            docs, seqs, sources = [], [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                found = {}
                for end, (size, marks) in automaton.iter(text):
                    for k, (seq, mark, source) in enumerate(marks):
                        if text.startswith(mark, end + 1 - size):
                            found[id(marks), k] = (seq, source)
                for seq, source in found.values():
                    docs.append(row)
                    seqs.append(seq)
                    sources.append(source)
            if docs:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(docs)), pa.array(seqs, kinds[0]), pa.array(sources, kinds[1])], ["doc_id", "mark_seq", "source"])

    return search


def taint_sources(matches: DataFrame) -> DataFrame:
    """doc_id, sources (distinct, in the order of their first mark), origin (of the latest mark)."""
    firsts = matches.groupBy("doc_id", "source").agg(F.min("mark_seq").alias("first"), F.max("mark_seq").alias("last"))
    return firsts.groupBy("doc_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("first", "source"))), lambda x: x["source"]).alias("sources"),
        F.max_by("source", "last").alias("origin"),
    )


def canary(seed: str, id_column: Column) -> Column:
    """A nonce that can be made again from a secret seed and an id."""
    return F.concat(F.lit("canary-"), F.substring(F.sha2(F.concat_ws(":", F.lit(seed), id_column.cast("string")), 256), 1, 32))


def inject_canary(prompt: Column, nonce: Column) -> Column:
    added = F.concat(prompt, F.lit("\n\n[internal-reference:"), nonce, F.lit("]"))
    return F.when((nonce == "") | prompt.contains(nonce), prompt).otherwise(added)


def leaked_canary(output: Column, canaries: list[str]) -> Column:
    """struct(canary, start) of the first listed one that the output contains, else null."""
    found = [
        F.when(output.contains(c), F.struct(F.lit(c).alias("canary"), (F.locate(c, output) - 1).alias("start")))
        for c in canaries
        if c
    ]
    return F.coalesce(*found) if found else F.lit(None).cast("struct<canary:string,start:int>")


def cut_role_markers(c: Column) -> Column:
    return F.regexp_replace(c, F.lit(rx.CUT_MARKERS), F.lit(""))


def datamark(c: Column, marker: str = MARKER) -> Column:
    """A marker before each line. Fails on a text that holds the marker."""
    if not marker:
        raise ValueError("the marker must not be empty")
    forged = F.raise_error(F.lit("the text already holds the marker"))
    marked = F.concat(F.lit(marker), F.replace(c, F.lit("\n"), F.lit("\n" + marker)))
    return F.when(c.contains(marker), forged.cast("string")).otherwise(marked)


def delimit(c: Column, delimiter: Column) -> Column:
    forged = F.raise_error(F.lit("the text already holds the delimiter"))
    return F.when(c.contains(delimiter), forged.cast("string")).otherwise(F.concat_ws("\n", delimiter, c, delimiter))


def spotlight_encode(c: Column) -> Column:
    """base64 of the UTF-8 bytes, in one line."""
    return F.regexp_replace(F.base64(F.encode(c, "UTF-8")), r"\s", "")


def assemble(parts: DataFrame, key: str, system: str, nonce: str | None = None) -> DataFrame:
    """parts (key, pos, content) of untrusted text and a system prompt -> (key, pos, role, content)."""
    head = F.lit(system) if nonce is None else inject_canary(F.lit(system), F.lit(nonce))
    first = parts.select(key).distinct().select(key, F.lit(0).cast("long").alias("pos"), F.lit("system").alias("role"), head.alias("content"))
    rest = parts.select(key, F.col("pos").cast("long").alias("pos"), F.lit("user").alias("role"), datamark(cut_role_markers(F.col("content"))).alias("content"))
    return first.unionByName(rest)


def request_gate(body: Column, verdict: Column, codes: Column, field: str = "input", status: int = 400) -> Column:
    """struct(status, error, codes) for a JSON request body: blocked ones and malformed ones are refused."""
    valid = F.try_parse_json(body).isNotNull()
    none = F.array().cast("array<string>")
    return (
        F.when(~F.coalesce(valid, F.lit(False)), F.struct(F.lit(status).alias("status"), F.lit("invalid json").alias("error"), none.alias("codes")))
        .when(F.get_json_object(body, f"$.{field}").isNull() | (verdict != "block"), F.struct(F.lit(200).alias("status"), F.lit(None).cast("string").alias("error"), none.alias("codes")))
        .otherwise(F.struct(F.lit(status).alias("status"), F.lit("blocked").alias("error"), codes.alias("codes")))
    )


def wrap(df: DataFrame, verdict: str = "verdict", text: str = "text", sanitized: str = "sanitized") -> DataFrame:
    """Rows that aren't blocked, with the sanitised text in the text's place."""
    return df.where(F.col(verdict) != "block").withColumn(text, F.col(sanitized))
