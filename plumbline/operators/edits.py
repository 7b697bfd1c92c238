"""Programs over operators: edit commands that replay in order, workflows, and history."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import table as tab
from plumbline.operators.table import Refused

#: What each kind of command does to a table; arguments come from its JSON.
COMMANDS: dict[str, Callable[..., DataFrame]] = {
    "set-value": lambda df, field, value, scope=None: tab.set_value(df, field, value, scope),
    "calculate": lambda df, field, expression, scope=None: tab.calculate(df, field, expression, scope),
    "add-field": lambda df, field, type, initial=None: tab.add_field(df, field, type, initial),  # noqa: A002
    "delete-field": lambda df, field: tab.delete_field(df, field),
    "rename-field": lambda df, field, to: tab.rename_field(df, field, to),
    "retype-field": lambda df, field, type, force=False: tab.retype_field(df, field, type, force),  # noqa: A002
    "filter": lambda df, expression: tab.filtered(df, expression),
    "rename-layer": lambda df, layer, to: df.withColumn("layer", F.when(F.col("layer") == layer, to).otherwise(F.col("layer"))),
    "delete-layer": lambda df, layer: df.where(~F.col("layer").eqNullSafe(F.lit(layer))),
    "split-layer": lambda df, layer, field: df.withColumn(
        "layer", F.when(F.col("layer") == layer, F.concat_ws("-", "layer", F.coalesce(F.col(field).cast("string"), F.lit("(empty)")))).otherwise(F.col("layer"))
    ),
    "merge-layers": lambda df, layers, into: df.withColumn("layer", F.when(F.col("layer").isin(layers), into).otherwise(F.col("layer"))),
}
#: Commands that lose data and need to be confirmed.
RISKY = ("delete-field", "retype-field", "delete-layer", "filter")


def replay(df: DataFrame, commands: list[dict], protected: tuple[str, ...] = ()) -> DataFrame:
    """Applies commands in order to the whole table. The first that is refused stops all of them."""
    for k, command in enumerate(commands):
        args = dict(command)
        kind = args.pop("kind", None)
        if kind not in COMMANDS:
            raise Refused(f"command {k + 1}: there is no kind {kind!r}")
        touched = {args.get("layer"), *args.get("layers", ())}
        if touched & set(protected):
            raise Refused(f"command {k + 1}: layer {sorted(touched & set(protected))[0]!r} is protected")
        try:
            df = COMMANDS[kind](df, **args)
        except (ValueError, TypeError) as e:
            raise Refused(f"command {k + 1} ({kind}): {e}") from e
    return df


@dataclass
class Workflow:
    """Steps that were recorded once and run on other tables."""

    name: str
    steps: list[dict] = field(default_factory=list)

    def to_json(self) -> str:
        return json.dumps({"name": self.name, "steps": self.steps}, sort_keys=True)

    @staticmethod
    def from_json(text: str) -> Workflow:
        raw = json.loads(text)
        return Workflow(str(raw["name"]), list(raw["steps"]))

    def unconfirmed(self) -> list[int]:
        return [i for i, s in enumerate(self.steps) if s.get("kind") in RISKY]

    def run(self, df: DataFrame, confirmed: set[int] = frozenset(), protected: tuple[str, ...] = ()) -> DataFrame:
        waiting = [i for i in self.unconfirmed() if i not in confirmed]
        if waiting:
            raise Refused(f"step {waiting[0] + 1} ({self.steps[waiting[0]]['kind']}) needs to be confirmed")
        return replay(df, self.steps, protected)


@dataclass
class History:
    """Versions as plans: undo and redo only choose which plan is current."""

    versions: list[tuple[str, DataFrame]]
    at: int = 0
    most: int = 50

    @staticmethod
    def of(df: DataFrame) -> History:
        return History([("start", df)])

    @property
    def current(self) -> DataFrame:
        return self.versions[self.at][1]

    def record(self, name: str, df: DataFrame) -> None:
        self.versions = [*self.versions[: self.at + 1], (name, df)][-self.most :]
        self.at = len(self.versions) - 1

    def undo(self) -> DataFrame:
        self.at = max(0, self.at - 1)
        return self.current

    def redo(self) -> DataFrame:
        self.at = min(len(self.versions) - 1, self.at + 1)
        return self.current

    def revert_to(self, name: str) -> DataFrame:
        found = [i for i, (n, _) in enumerate(self.versions) if n == name]
        if not found:
            raise Refused(f"there is no version {name!r}")
        self.at = found[-1]
        return self.current


def match_sources(project: DataFrame, supplied: DataFrame) -> DataFrame:
    """Files of a project (``path, name, sha256``) against those supplied: by hash, then by name in any case."""
    by_hash = supplied.groupBy("sha256").agg(F.min("path").alias("same"))
    by_name = supplied.groupBy(F.lower("name").alias("low")).agg(F.min("path").alias("named"), F.count(F.lit(1)).alias("n"))
    joined = project.join(by_hash, "sha256", "left").withColumn("low", F.lower("name")).join(by_name, "low", "left")
    state = F.when(F.col("same").isNotNull(), "matched").when(F.col("n") > 1, "ambiguous").when(F.col("n") == 1, "changed").otherwise("missing")
    return joined.select("path", "name", state.alias("state"), F.coalesce("same", "named").alias("found"))
