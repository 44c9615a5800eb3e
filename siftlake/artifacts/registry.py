"""Named, parameterised artifacts: a table function from input tables to a lazy DataFrame.

Composition is a plain function call. `collect` runs a selection, writes each result and
returns one outcome row per artifact.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftlake.operators.ledger import POSTPROCESSING

DEFAULT_TIME_LIMIT = 400


@dataclass(frozen=True)
class Parameter:
    name: str
    default: object = None
    kind: str = "string"


@dataclass(frozen=True)
class Artifact:
    name: str
    fn: Callable[..., DataFrame]
    inputs: tuple[str, ...]
    params: tuple[Parameter, ...] = ()
    description: str = ""

    def __call__(self, tables: dict[str, DataFrame], **args) -> DataFrame:
        known = {p.name: p.default for p in self.params}
        unknown = set(args) - set(known)
        if unknown:
            raise TypeError(f"{self.name} has no parameter {sorted(unknown)}")
        return self.fn(*[tables[i] for i in self.inputs], **{**known, **args})


_ARTIFACTS: dict[str, Artifact] = {}


def register(name: str, fn: Callable[..., DataFrame], inputs: list[str],
             params: list[Parameter] | None = None, description: str = "") -> Artifact:
    entry = Artifact(name, fn, tuple(inputs), tuple(params or ()), description or (fn.__doc__ or "").strip())
    _ARTIFACTS[name] = entry
    return entry


def artifact(name: str, inputs: list[str], params: list[Parameter] | None = None):
    def wrap(fn):
        register(name, fn, inputs, params)
        return fn

    return wrap


def get(name: str) -> Artifact:
    return _ARTIFACTS[name]


def names() -> list[str]:
    return list(_ARTIFACTS)


def describe() -> list[tuple[str, str, str, str]]:
    """(artifact, parameter, default as text, type) of everything registered."""
    return [(a.name, p.name, str(p.default or ""), p.kind) for a in _ARTIFACTS.values() for p in a.params]


def selected(lists: dict[str, list[str]]) -> list[str]:
    """The calls to run: the default list in order, each once. The skip list only names what
    is known but not run by default."""
    return list(dict.fromkeys(lists.get("default", [])))


def add_to_list(lists: dict[str, list[str]], name: str, category: str = "default") -> dict[str, list[str]]:
    """The lists with a new artifact, unless either list already has a call of that name."""
    if category not in ("default", "skip"):
        raise ValueError(f"unknown category {category}")
    listed = {call.split("(")[0].strip() for calls in lists.values() for call in calls}
    if name in listed:
        return lists
    return {**lists, category: [*lists.get(category, []), f"{name}()"]}


def _bytes_below(spark: SparkSession, path: str) -> int:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(target).getLength()


def collect(spark: SparkSession, calls: list[tuple[str, dict]], tables: dict[str, DataFrame], out: str,
            fmt: str = "parquet", time_limit: int = DEFAULT_TIME_LIMIT) -> DataFrame:
    """Run artifacts by name, each to `out`/<name>, and return the outcome ledger (`size` in
    bytes) with the number of `rows`. A failing or overlong artifact becomes a failed row; the
    others still run."""
    outcomes = []
    for name, args in calls:
        started, error, size, rows, path = time.time(), None, None, None, f"{out}/{name.replace('/', '_')}"
        group = f"artifact-{name}-{started}"
        timer = threading.Timer(time_limit, spark.sparkContext.cancelJobGroup, [group])
        timer.daemon = True
        try:
            timer.start()
            spark.sparkContext.setJobGroup(group, f"artifact {name}", interruptOnCancel=True)
            seen = Observation(group)
            result = get(name)(tables, **args).observe(seen, F.count(F.lit(1)).alias("rows"))
            result.write.mode("overwrite").format(fmt).save(path)
            size, rows = _bytes_below(spark, path), seen.get["rows"]
        except Exception as exc:
            error = f"{type(exc).__name__}: {str(exc).splitlines()[0] if str(exc) else ''}"
        finally:
            timer.cancel()
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        outcomes.append((path, path.rsplit("/", 1)[-1], name, f"{name}({args})", size, error is None,
                         time.time() - started, error, None, None, 0 if error is None else 1, None, rows))
    return spark.createDataFrame(outcomes, T.StructType([*POSTPROCESSING.fields, T.StructField("rows", T.LongType())]))
