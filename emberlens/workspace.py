"""One object for a warehouse folder: imports, exploration, analyses and the case."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession

from emberlens.case import evidence, report
from emberlens.operators import catalog, compare, correlate, explore, patterns, tokenindex
from emberlens.plans import alive, runs
from emberlens.sources import files, ingest, otlp, profiles, segments


class Workspace:
    """Methods read the published datasets, or those of ``names``, and return DataFrames."""

    def __init__(self, spark: SparkSession, warehouse: str, names: list[str] | None = None):
        self.spark, self.warehouse, self.names = spark, warehouse, names

    # imports

    def import_json_lines(self, path: str, dataset: str, profile: profiles.Profile = profiles.JSONL) -> dict:
        return ingest.publish_records(ingest.normalised(files.placed_lines(self.spark, path), profile, dataset, path), self.warehouse, dataset)

    def import_csv(self, path: str, dataset: str, profile: profiles.Profile = profiles.CSV) -> dict:
        rows = files.placed_csv(self.spark, path, profile.delimiter, profile.header)
        return ingest.publish_records(ingest.normalised(rows, profile, dataset, path, strings_only=True), self.warehouse, dataset)

    def import_otlp(self, path: str, dataset: str, signal: str) -> dict:
        make = {"logs": otlp.logs, "spans": otlp.spans, "metrics": otlp.metric_points}[signal]
        lines = files.text_lines(self.spark, path)
        rows, rejects = make(lines, dataset)
        for name, of in (("resources", otlp.resources), ("scopes", otlp.scopes)):
            of(lines, signal).write.mode("append").parquet(f"{self.warehouse}/dimensions/{name}")
        return ingest.publish(rows, rejects.unionByName(otlp.envelope_rejects(lines), allowMissingColumns=True), self.warehouse, dataset, signal)

    # rows

    def logs(self) -> DataFrame:
        return ingest.published(self.spark, self.warehouse, self.names)

    def spans(self) -> DataFrame:
        return ingest.published(self.spark, self.warehouse, self.names, "spans")

    def metric_points(self) -> DataFrame:
        return ingest.published(self.spark, self.warehouse, self.names, "metrics")

    def resources(self) -> DataFrame:
        """``(resource_id, attributes_json)``; for ``explore.with_dimension``."""
        return self.spark.read.schema("resource_id string, attributes_json string").parquet(f"{self.warehouse}/dimensions/resources").distinct()

    def scopes(self) -> DataFrame:
        return self.spark.read.schema("scope_id string, name string, version string").parquet(f"{self.warehouse}/dimensions/scopes").distinct()

    def fields(self) -> DataFrame:
        """Distinct values are counted exactly up to ``catalog.EXACT`` of them."""
        return catalog.merged(catalog.field_catalog(self.logs(), exact_to=catalog.EXACT))

    def page(self, where: Column | None = None, window: explore.Window = explore.Window(), **more) -> DataFrame:
        """The first page opens the newest files only; others, by a cursor, scan."""
        if set(more) <= {"limit"}:
            return segments.newest_page(self.spark, segments.zones(self.spark, ingest.published_runs(self.spark, self.warehouse, self.names), self.warehouse), where, window, **more)[0]
        return explore.page(self.logs(), where, window, **more)

    def find(self, text: str) -> DataFrame:
        """Rows with the words of ``text`` one after the other, by the index as far as there is one; ``index`` builds it."""
        return tokenindex.find(self.spark, self.warehouse, text, self.names)

    def index(self) -> int:
        return tokenindex.update(self.spark, self.warehouse)

    def counts(self, where: Column | None = None, window: explore.Window = explore.Window()) -> DataFrame:
        return explore.counts(self.logs(), where, window)

    def histogram(self, where: Column | None = None, window: explore.Window = explore.Window(), bins: int = 60) -> DataFrame:
        return explore.histogram(self.logs(), where, window, bins)

    def facets(self, fields: dict[str, Column], where: Column | None = None, window: explore.Window = explore.Window(), most: int = 10) -> DataFrame:
        return explore.facets(self.logs(), fields, where, window, most)

    def export_json_lines(self, path: str, where: Column | None = None, window: explore.Window = explore.Window(), most_rows: int = 1_000_000) -> bool:
        """Writes one file of lines in the canonical order, never over an old one; whether rows were cut off."""
        lines = explore.jsonl_rows(explore.scoped(self.logs(), where, window), "event_time", "dataset_id")
        kept, cut = explore.export(lines, explore.canonical_order(), most_rows)
        kept.orderBy("place").select("line").coalesce(1).write.mode("errorifexists").text(path)
        return cut

    # analyses

    def revisions(self) -> str | None:
        """The published datasets' revisions, from what publication wrote down; None where it did not yet."""
        found = {r["dataset_id"]: r["revision"] for r in ingest.revisions(self.spark, self.warehouse, self.names).orderBy("dataset_id").collect()}  # a row a dataset
        return json.dumps(found) if all(found.values()) else None

    def _run(self, name: str, logs: DataFrame, config: dict, analysis, *order: str) -> str:
        return runs.run(name, logs, config, analysis, self.warehouse, order, self.revisions() or runs.frozen(self.logs()))

    def patterns(self, where: Column | None = None, window: explore.Window = explore.Window()) -> str:
        config = {"where": str(where), "window": str(window)}
        return self._run("patterns", explore.scoped(self.logs(), where, window), config, lambda x: patterns.run(patterns.with_template(x)), "pattern_id")

    def compare(self, dimension: str, baseline: tuple[int, int], suspect: tuple[int, int]) -> str:
        config = {"dimension": dimension, "baseline": baseline, "suspect": suspect}
        return self._run("comparison", self.logs(), config, lambda x: compare.compare(x, compare.key_of(dimension), baseline, suspect), "key")

    def correlate(self, key: str, **normal) -> str:
        return self._run("correlation", self.logs(), {"key": key, **normal}, lambda x: correlate.signals(correlate.members(correlate.with_key(x, key, **normal))), "kind", "key", "signal_id")

    def result(self, run_id: str) -> tuple[DataFrame, bool]:
        now = self.revisions()
        return runs.result(self.spark, self.warehouse, run_id, None if now else self.logs(), now)

    def recover(self, lease: float = alive.LEASE) -> dict[str, list[str]]:
        """To be called on opening: ends analyses that broke off, deletes what they and broken imports left, and returns both by their
        runs. What has given a sign of life within ``lease`` seconds is left alone."""
        living = alive.Living(self.spark, self.warehouse, lease)
        swept = {"imports": ingest.sweep(self.spark, self.warehouse, living), "analyses": runs.sweep(self.spark, self.warehouse, living)}
        for run in living.gone():
            alive.delete(self.spark, f"{self.warehouse}/_alive/{run}")
        return swept

    # case

    def verify(self, pins: DataFrame, current: DataFrame | None = None) -> DataFrame:
        known = ingest.revisions(self.spark, self.warehouse, self.names) if self.revisions() else None
        return evidence.verify(pins, self.logs(), current, revisions=known)

    def bundle(self, title: str, pins: DataFrame, markers: DataFrame | None = None) -> bytes:
        logs = self.logs()
        return report.bundle(title, pins, evidence.timeline(pins, logs, markers), self.verify(pins), report.subset(pins, logs))
