"""The catalogue's tables as Parquet folders with fixed schemas, and the plain reads of them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ATTRIBUTES = "struct<tasks: array<string>, license: string, context: long, params: long, params_read_from: string, open_weights: boolean, open_weights_source: string, limits: string, includes: array<string>, released: string, knowledge: string, max_output: long, reasoning: boolean, tool_call: boolean>"
SCHEMAS = {
    "providers": "id string, name string, url string, kind string, notes string, raised long, rounds long, raised_source string, founded string, listed boolean, backing string, status string",
    "entities": f"id string, register string, name string, maker string, family string, version string, derived_from string, input_kind string, output_kind string, attrs {ATTRIBUTES}",
    "aliases": "source string, alias string, entity_id string",
    "offerings": "id long, entity_id string, provider_id string, way string, variant string, limits string, allowance map<string, double>, status string, first_seen date, last_seen date",
    "prices": "seq long, offering_id long, dimension string, micros_per_unit long, basis string, source_url string, taken_at date",
    "metrics": "seq long, offering_id long, metric string, value double, basis string, source_url string, taken_at date",
    "benchmarks": "seq long, entity_id string, suite string, metric string, value double, rank long, out_of long, basis string, source_url string, taken_at date",
    "suites": "id string, name string, measurer string, url string, metric string, subject string, lower_is_better boolean, updated string",
    "docs": "seq long, subject string, kind string, field string, text string, source_url string, taken_at date",
    "unmatched_listings": "source string, alias string, payload string, first_seen date, last_seen date",
    "investments": "fund_id string, company_id string, source_url string",
    "candidates": "id string, kind string, name string, maker string, why string, held_since date, sellers long, low long, dimension string, body string",
    "source_runs": "source string, ran_at date, fetched long, unchanged long, read long, bound long, written long, seconds double, note string",
    "terms": "slug string, term string, kind string, short string, body string, also array<string>, see array<struct<label: string, href: string>>",
    "checks": "name string, suite string, blocking boolean, findings long, asks string, ran_at date",
    "supply_seen": "file string, hash string, done_at date",
}


@dataclass(frozen=True)
class Stored:
    """A stored catalogue: one DataFrame an attribute, with the table's schema whatever its files have; a missing table is an error when it is read."""

    spark: SparkSession
    path: str

    def __getattr__(self, name: str) -> DataFrame:
        if name not in SCHEMAS:
            raise AttributeError(name)
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.path}/{name}")

    def of_register(self, register: str) -> DataFrame:
        return self.entities.where(F.col("register") == register).orderBy("name", "id")

    def aliases_of(self, entity: str) -> DataFrame:
        return self.aliases.where(F.col("entity_id") == entity).orderBy("source", "alias")

    def docs_of(self, subject: str) -> DataFrame:
        return self.docs.where(F.col("subject") == subject).orderBy("kind", "field", "seq")

    def queue_of(self, source: str) -> DataFrame:
        return self.unmatched_listings.where(F.col("source") == source).orderBy(F.desc("last_seen"), "alias")

    def terms_in_order(self) -> DataFrame:
        return self.terms.orderBy(F.lower("term"), "slug")


def read_catalogue(spark: SparkSession, path: str) -> Stored:
    return Stored(spark, path.rstrip("/"))
