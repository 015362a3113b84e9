"""A graph of DataFrame nodes: each has inputs, a function and a stored result, and is made anew only when it must."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Node:
    """name, the nodes it reads, and how it is made of them.  A volatile input doesn't make its readers stale."""

    name: str
    make: Callable[..., DataFrame]
    inputs: tuple[str, ...] = ()
    volatile: bool = False


@dataclass
class Dag:
    """Nodes by name with their results as Parquet under root/<name>."""

    spark: SparkSession
    root: str
    nodes: dict[str, Node] = field(default_factory=dict)
    made: dict[str, DataFrame] = field(default_factory=dict)

    def add(self, name: str, inputs: tuple[str, ...] = (), volatile: bool = False):
        def wrap(make: Callable[..., DataFrame]):
            self.nodes[name] = Node(name, make, tuple(inputs), volatile)
            return make

        return wrap

    def order(self, *targets: str) -> list[str]:
        """The targets and all they need, inputs first."""
        out: list[str] = []
        open_: set[str] = set()

        def visit(name: str) -> None:
            if name in out:
                return
            if name in open_:
                raise ValueError(f"{name} needs itself")
            open_.add(name)
            for i in self.nodes[name].inputs:
                visit(i)
            open_.discard(name)
            out.append(name)

        for t in targets or self.nodes:
            visit(t)
        return out

    def _stored(self, name: str) -> int | None:
        """When the result was written, in milliseconds; None if there is none."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}/_SUCCESS")
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return fs.getFileStatus(path).getModificationTime() if fs.exists(path) else None

    def plan(self, *targets: str, refresh: frozenset[str] = frozenset()) -> dict[str, str]:
        """Why each node runs: asked, missing, an input runs, an input is newer; or that it is up to date."""
        why: dict[str, str] = {}
        for name in self.order(*targets):
            at = self._stored(name)
            firm = [i for i in self.nodes[name].inputs if not self.nodes[i].volatile]
            if name in refresh:
                why[name] = "asked"
            elif at is None:
                why[name] = "missing"
            elif any(why[i] != "up to date" for i in firm):
                why[name] = "an input runs"
            elif any((self._stored(i) or 0) > at for i in firm):
                why[name] = "an input is newer"
            else:
                why[name] = "up to date"
        return why

    def run(self, *targets: str, refresh: frozenset[str] = frozenset()) -> dict[str, DataFrame]:
        """Make what must be made, in order, and read the rest."""
        plan = self.plan(*targets, refresh=refresh)
        for name, why in plan.items():
            path = f"{self.root}/{name}"
            if why != "up to date":
                node = self.nodes[name]
                node.make(*[self.made[i] for i in node.inputs]).write.mode("overwrite").parquet(path)
            self.made[name] = self.spark.read.parquet(path)
        return {t: self.made[t] for t in targets or plan}
