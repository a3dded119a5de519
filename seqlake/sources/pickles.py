"""Pickled dictionaries and lists of plain values, read by a small stack machine that executes nothing.

Only the opcodes that plain dictionaries, lists, tuples, texts, numbers, truth values and None need are known; one that
names, imports, builds or calls anything is an error, so a file can't make a reader run code.
"""

from __future__ import annotations

import pickletools
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MARK = object()
# Opcodes that push their argument, that push a constant, that remember the top, and that recall it.
_PUSH = {"BINUNICODE", "SHORT_BINUNICODE", "BINUNICODE8", "UNICODE", "BININT", "BININT1", "BININT2", "INT", "LONG", "LONG1", "LONG4", "BINFLOAT", "FLOAT", "STRING", "BINSTRING", "SHORT_BINSTRING"}
_CONSTANT = {"NONE": lambda: None, "NEWTRUE": lambda: True, "NEWFALSE": lambda: False, "EMPTY_DICT": dict, "EMPTY_LIST": list, "EMPTY_TUPLE": tuple}
_REMEMBER, _RECALL = {"PUT", "BINPUT", "LONG_BINPUT"}, {"GET", "BINGET", "LONG_BINGET"}
_TUPLES = {"TUPLE1": 1, "TUPLE2": 2, "TUPLE3": 3}


def plain_value(data: bytes) -> Any:
    """The dictionary, list, tuple, text, number, truth value or None that a pickle holds; ValueError for anything else."""
    stack: list = []
    memo: dict[int, Any] = {}

    def marked() -> list:
        at = max(i for i, x in enumerate(stack) if x is _MARK)
        items = stack[at + 1 :]
        del stack[at:]
        return items

    def pairs(into: dict, items: list) -> None:
        if not isinstance(into, dict) or len(items) % 2:
            raise ValueError("entries without a dictionary")
        for k, v in zip(items[::2], items[1::2], strict=True):
            into[k] = v

    try:
        for op, argument, _ in pickletools.genops(data):
            name = op.name
            if name in ("PROTO", "FRAME"):
                continue
            if name == "STOP":
                if len(stack) != 1 or stack[0] is _MARK:
                    raise ValueError("values are left over at the end")
                return stack[0]
            if name in _PUSH:
                stack.append(argument)
            elif name in _CONSTANT:
                stack.append(_CONSTANT[name]())
            elif name == "MARK":
                stack.append(_MARK)
            elif name == "MEMOIZE":
                memo[len(memo)] = stack[-1]
            elif name in _REMEMBER:
                memo[argument] = stack[-1]
            elif name in _RECALL:
                stack.append(memo[argument])
            elif name == "SETITEM":
                v, k = stack.pop(), stack.pop()
                pairs(stack[-1], [k, v])
            elif name == "SETITEMS":
                items = marked()
                pairs(stack[-1], items)
            elif name in ("APPEND", "APPENDS"):
                items = marked() if name == "APPENDS" else [stack.pop()]
                if not isinstance(stack[-1], list):
                    raise ValueError("items without a list")
                stack[-1].extend(items)
            elif name == "DICT":
                made: dict = {}
                pairs(made, marked())
                stack.append(made)
            elif name == "LIST":
                stack.append(marked())
            elif name == "TUPLE":
                stack.append(tuple(marked()))
            elif name in _TUPLES:
                items = stack[-_TUPLES[name] :]
                del stack[-_TUPLES[name] :]
                stack.append(tuple(items))
            else:
                raise ValueError(f"opcode {name} is not plain data")
    except ValueError:
        raise
    except Exception as e:  # a stack that runs empty, a value that can't be a key, a place that was never remembered
        raise ValueError(f"damaged pickle: {e!r}") from None
    raise ValueError("no end")


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    text = lambda x: None if x is None else str(x)
    for b in batches:
        for name, content in zip(b.column("file").to_pylist(), b.column("content").to_pylist(), strict=True):
            try:
                value = plain_value(content)
                if not isinstance(value, dict | list | tuple):
                    raise ValueError(f"{type(value).__name__} is no table")
                rows = list(value.items()) if isinstance(value, dict) else list(enumerate(value))
                if any(isinstance(x, dict | list | tuple) for r in rows for x in r):
                    raise ValueError("entries are nested")
            except ValueError as e:
                raise ValueError(f"{name}: {e}") from None
            for at in range(0, len(rows), 50_000):
                part = rows[at : at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array([text(k) for k, _ in part], pa.string()), pa.array([text(v) for _, v in part], pa.string())], ["file", "key", "value"])


def pickled_table(spark: SparkSession, path: str, key: str = "string", value: str = "string") -> DataFrame:
    """(file, key, value) of pickled dictionaries, or of lists with their places from 0 as keys; a file is one task.

    key and value are types that the texts are cast to; a text that doesn't fit is null. A file that holds anything but
    plain entries is an error that names it, and nothing in it is executed. A file must fit a task's memory.
    """
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    rows = files.mapInArrow(_entries, "file string, key string, value string")
    return rows.select("file", F.col("key").try_cast(key).alias("key"), F.col("value").try_cast(value).alias("value"))
