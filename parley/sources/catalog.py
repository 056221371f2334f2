"""Dataset references and the catalog that they are looked up in."""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame

from parley.operators import normalize as N


@dataclass(frozen=True)
class Reference:
    """[hf|ms::]id_or_path[:subset/subset][#rows]"""

    name: str
    subsets: tuple[str, ...] = ()
    rows: int | None = None
    hub: str | None = None

    def text(self) -> str:
        out = f"{self.hub}::{self.name}" if self.hub else self.name
        out += ":" + "/".join(self.subsets) if self.subsets else ""
        return out + (f"#{self.rows}" if self.rows is not None else "")


def parse_reference(text: str, exists: Callable[[str], bool] = os.path.exists) -> Reference:
    """Parses a reference. What exists as a path isn't split any further, so paths may have the marks in them."""
    hub, rows, subsets, rest = None, None, (), text
    if not exists(rest) and "::" in rest:
        hub, rest = rest.split("::", 1)
        if hub not in ("hf", "ms"):
            raise ValueError(f"unknown hub {hub}")
    if not exists(rest) and "#" in rest:
        rest, count = rest.rsplit("#", 1)
        rows = int(count)
    if not exists(rest) and ":" in rest:
        rest, names = rest.split(":", 1)
        subsets = tuple(s.strip() for s in names.split("/"))
    return Reference(rest, subsets, rows, hub)


@dataclass(frozen=True)
class Subset:
    name: str = "default"
    subset: str = "default"
    split: tuple[str, ...] | None = None
    preprocess: Callable[[DataFrame], DataFrame] | None = None
    weak: bool = False


@dataclass(frozen=True)
class Dataset:
    """A catalog entry. Subsets take its splits and preprocessing where they have none."""

    name: str | None = None
    path: str | None = None
    hub_ids: tuple[str, ...] = ()
    subsets: tuple[Subset, ...] = (Subset(),)
    split: tuple[str, ...] = ("train",)
    preprocess: Callable[[DataFrame], DataFrame] = N.auto
    tags: tuple[str, ...] = ()
    huge: bool = False
    options: dict = field(default_factory=dict, compare=False)

    @property
    def key(self):
        return self.name or (self.hub_ids, self.path)

    def select(self, wanted: tuple[str, ...] = ()) -> list[Subset]:
        """The only subset or `default` where none is wanted, all but weak ones for `all`, else those named; unknown names
        are subsets of the source."""
        by_name = {s.name: s for s in self.subsets}
        if not wanted:
            if len(self.subsets) > 1 and "default" not in by_name:
                raise ValueError("the dataset has several subsets; name one")
            chosen = [self.subsets[0] if len(self.subsets) == 1 else by_name["default"]]
        elif wanted == ("all",) and "all" not in by_name:
            chosen = [s for s in self.subsets if not s.weak]
        else:
            chosen = [by_name.get(n) or Subset(n, n) for n in wanted]
        return [replace(s, split=s.split or self.split, preprocess=s.preprocess or self.preprocess) for s in chosen]


class Catalog:
    def __init__(self) -> None:
        self.entries: dict[object, Dataset] = {}

    def register(self, dataset: Dataset, exist_ok: bool = False) -> None:
        if dataset.key in self.entries and not exist_ok:
            raise ValueError(f"{dataset.key} is registered already")
        self.entries[dataset.key] = dataset

    def register_info(self, info: str | list[dict], base: str = ".") -> list[Dataset]:
        """Registers entries given as a list, as JSON text, or in a JSON file whose folder relative paths start from."""
        if isinstance(info, str):
            if os.path.exists(info):
                base = os.path.dirname(os.path.abspath(info))
                with open(info, encoding="utf-8") as f:
                    info = json.load(f)
            else:
                info = json.loads(info)
        out = []
        for item in info:
            dataset = Dataset(
                name=item.get("dataset_name"),
                path=_absolute(item.get("dataset_path"), base),
                hub_ids=tuple(item[k] for k in ("ms_dataset_id", "hf_dataset_id") if item.get(k)),
                subsets=tuple(_subset(s) for s in item.get("subsets", [])) or (Subset(),),
                split=tuple(item.get("split", ["train"])),
                preprocess=_preprocess(item) or N.auto,
                tags=tuple(item.get("tags", [])),
                huge=bool(item.get("huge_dataset", False)),
            )
            self.register(dataset, exist_ok=True)
            out.append(dataset)
        return out

    def find(self, reference: Reference) -> Dataset:
        """By name or id, else by the last part of a path or id - of a hub's cache folder as well - else a default entry."""
        for d in self.entries.values():
            if reference.name == d.name or reference.name in d.hub_ids or d.path and reference.name == d.path:
                return d
        tail = reference.name.rstrip("/")
        if "/datasets--" in tail and "/snapshots/" in tail:
            tail = tail.split("/datasets--", 1)[1].split("/snapshots/", 1)[0].replace("--", "/")
        tail = tail.rsplit("/", 1)[-1]
        for d in self.entries.values():
            if any(i.rsplit("/", 1)[-1] == tail for i in d.hub_ids):
                return d
        return Dataset(name=reference.name)

    def names(self) -> list[str]:
        return sorted(str(d.name or (d.hub_ids or (d.path,))[0]) for d in self.entries.values())


def _absolute(path: str | None, base: str) -> str | None:
    return path if path is None or os.path.isabs(path) else os.path.join(base, path)


def _preprocess(item: dict) -> Callable[[DataFrame], DataFrame] | None:
    if "messages" in item:
        keys = {k: v for k, v in item["messages"].items() if k in ("role_key", "content_key", "inner_key")}
        return lambda df: N.messages_layout(df, item.get("columns"), **keys)
    return (lambda df: N.auto(df, item["columns"])) if "columns" in item else None


def _subset(item: str | dict) -> Subset:
    if isinstance(item, str):
        return Subset(item, item)
    return Subset(item.get("name", item.get("subset", "default")), item.get("subset", "default"), tuple(item["split"]) if "split" in item else None, _preprocess(item), bool(item.get("is_weak_subset", False)))


CATALOG = Catalog()
