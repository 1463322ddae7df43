"""Running scripts: statements become datasets, MATERIALIZE names the results."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from regionframe.lang import grammar as g
from regionframe.lang.tokens import ScriptError
from regionframe.model import Dataset
from regionframe.plans.ranges import BIN


class Script:
    """Analyses a script against ``sources`` (dataset name -> Dataset) and an optional ``loader`` (name or path, parser name) -> Dataset.

    Nothing runs here: results are lazy datasets.
    """

    def __init__(self, sources: Mapping[str, Dataset] | None = None, loader: Callable[[str, str | None], Dataset] | None = None, bin_size: int = BIN, max_distance: int = 100_000):
        self.sources, self.loader = dict(sources or {}), loader
        self.bin_size, self.max_distance = bin_size, max_distance

    def run(self, text: str) -> dict[str, Dataset]:
        """The materialised datasets, by path, or by variable where none is given."""
        self.variables: dict[str, Dataset] = {}
        out: dict[str, Dataset] = {}
        stored = g.statements(text)
        if not any(s.operator == "MATERIALIZE" for s in stored):
            raise ScriptError("nothing is materialized")
        for s in stored:
            try:
                if s.operator == "MATERIALIZE":
                    out[s.path or s.inputs[0]] = self._variable(s.inputs[0])
                else:
                    self.variables[s.target] = self._assigned(s)
            except ScriptError:
                raise
            except ValueError as e:
                raise ScriptError(f"{s.target or 'MATERIALIZE'}: {e}") from e
        return out

    def _variable(self, name: str) -> Dataset:
        if name not in self.variables:
            raise ScriptError(f"variable {name} is not defined")
        return self.variables[name].named(name)

    def _source(self, name: str, parser: str | None) -> Dataset:
        if name in self.variables:
            return self._variable(name)
        if name in self.sources:
            return self.sources[name]
        if self.loader is None:
            raise ScriptError(f"no dataset {name}")
        return self.loader(name, parser)

    def _assigned(self, s: g.Statement) -> Dataset:
        if s.target in self.variables:
            raise ScriptError(f"variable {s.target} is defined twice")
        arity = g.OPERATORS[s.operator][0]
        if len(s.inputs) != arity:
            raise ScriptError(f"{s.operator} takes {arity} input{'s' * (arity > 1)}, not {len(s.inputs)}")
        if s.unnamed and s.operator in ("DIFFERENCE", "MERGE", "UNION"):
            raise ScriptError(f"{s.operator} takes no unnamed parameter")
        inputs = [self._source(s.inputs[0], s.options.get("parser"))] if s.operator == "SELECT" else [self._variable(n) for n in s.inputs]
        return getattr(self, "_" + s.operator.lower())(s, *inputs)

    def _option(self, s: g.Statement, name: str, rule, default=None):
        return g.whole(s.options[name], rule) if name in s.options else default

    def _select(self, s, ds):
        meta = g.whole(s.unnamed, g.meta_condition) if s.unnamed else None
        semi = self._option(s, "semijoin", g.semijoin)
        if semi:
            semi = (semi[0], self._variable(semi[1]), semi[2])
        return ds.select(meta, self._option(s, "region", g.region_condition), semi)

    def _project(self, s, ds):
        update = self._option(s, "region_update", g.region_updates)
        keep, all_but = g.whole(s.unnamed, g.keep_list) if s.unnamed else (None if s.options else (), False)
        meta_keep, meta_all_but = self._option(s, "metadata", g.meta_keep_list, (None, False))
        return ds.project(keep, all_but, update, meta_keep, meta_all_but, self._option(s, "metadata_update", g.meta_updates))

    def _extend(self, s, ds):
        if not s.unnamed:
            raise ScriptError("EXTEND needs an aggregate")
        return ds.extend(g.whole(s.unnamed, g.named_aggregates))

    def _order(self, s, ds):
        def top(prefix):
            given = [h for h in ("top", "topg", "topp") if f"{prefix}_{h}" in s.options]
            if len(given) > 1:
                raise ScriptError(f"ORDER takes one of {prefix}_top, {prefix}_topg, {prefix}_topp")
            return (given[0], g.whole(s.options[f"{prefix}_{given[0]}"], lambda r: r.number())) if given else None

        meta = g.whole(s.unnamed, lambda r: g.order_keys(r, lambda q: q.dotted())) if s.unnamed else None
        region = self._option(s, "region_order", lambda r: g.order_keys(r, g.field_name))
        return ds.order(meta, top("meta"), region, top("region"))

    def _group(self, s, ds):
        key = g.whole(s.unnamed, g.riches) if s.unnamed else None
        if key and len(key) > 1:
            raise ScriptError("GROUP takes one metadata key")
        return ds.group(
            key[0] if key else None, self._option(s, "meta_aggregates", g.named_aggregates), self._option(s, "meta_group_name", lambda r: r.dotted(), "_group"),
            self._option(s, "region_keys", lambda r: r.many(lambda: g.field_name(r))), self._option(s, "region_aggregates", g.aggregates),
        )

    def _merge(self, s, ds):
        return ds.merge(self._option(s, "groupby", g.riches))

    def _union(self, s, x, y):
        return x.union(y, left_name=s.inputs[0], right_name=s.inputs[1])

    def _difference(self, s, x, y):
        exact = self._option(s, "exact", lambda r: r.word("TRUE", "FALSE"), "FALSE") == "TRUE"
        return x.difference(y, joinby=self._option(s, "joinby", g.riches), exact=exact, bin_size=self.bin_size)

    def _map(self, s, x, y):
        aggs = g.whole(s.unnamed, g.aggregates) if s.unnamed else []
        return x.map(y, aggs, self._option(s, "joinby", g.riches), self._option(s, "count_name", lambda r: r.dotted()), s.inputs[0], s.inputs[1], bin_size=self.bin_size)

    def _join(self, s, x, y):
        condition = g.whole(s.unnamed, g.atoms) if s.unnamed else []
        return x.join(
            y, condition, self._option(s, "joinby", g.riches), self._option(s, "on_attributes", g.on_attributes, ()), self._option(s, "output", lambda r: r.name(), "CONTIG"),
            s.inputs[0], s.inputs[1], max_distance=self.max_distance, bin_size=self.bin_size,
        )

    def _pile(self, s, ds, variant):
        if not s.unnamed:
            raise ScriptError(f"{s.operator} needs two bounds")
        low, high = g.whole(s.unnamed, g.bounds)
        return ds.cover(low, high, self._option(s, "groupby", g.riches), self._option(s, "aggregate", g.aggregates), variant, bin_size=self.bin_size)

    def _cover(self, s, ds):
        return self._pile(s, ds, "cover")

    def _flat(self, s, ds):
        return self._pile(s, ds, "flat")

    def _summit(self, s, ds):
        return self._pile(s, ds, "summit")

    def _histogram(self, s, ds):
        return self._pile(s, ds, "histogram")
