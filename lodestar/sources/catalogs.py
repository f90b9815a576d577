"""Catalogs: a filesystem catalog, and Spark settings for remote ones."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from .storage import Storage


class FilesystemCatalog:
    """Folders as namespaces, tables in them; a table's format shows in its folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.store = spark, root.rstrip("/"), Storage(spark, root)

    def namespaces(self) -> list[str]:
        return [n for n, _, _, folder in self.store.list() if folder]

    def create_namespace(self, name: str) -> None:
        self.store.write(f"{name}/.namespace", b"{}")

    def tables(self, namespace: str) -> list[str]:
        return [n for n, _, _, folder in self.store.list(namespace) if folder]

    def location(self, namespace: str, table: str) -> str:
        return f"{self.root}/{namespace}/{table}"

    def kind(self, namespace: str, table: str) -> str:
        if self.store.exists(f"{namespace}/{table}/_delta_log"):
            return "delta"
        return "iceberg" if self.store.exists(f"{namespace}/{table}/metadata") else "parquet"

    def open(self, namespace: str, table: str):
        from .delta import DeltaTable
        from .iceberg import IcebergTable

        if not self.store.exists(f"{namespace}/{table}"):
            raise FileNotFoundError(f"no table {namespace}.{table}")
        at = self.location(namespace, table)
        kind = self.kind(namespace, table)
        return DeltaTable(self.spark, at) if kind == "delta" else IcebergTable(self.spark, at) if kind == "iceberg" else self.spark.read.parquet(at)

    def drop(self, namespace: str, table: str) -> None:
        self.store.delete(f"{namespace}/{table}")

    def create_view(self, namespace: str, name: str, sql: str, dialect: str = "spark") -> None:
        """Creates or replaces a view's text for a dialect."""
        at = f"{namespace}/_views/{name}.json"
        texts = json.loads(self.store.read(at)) if self.store.exists(at) else {}
        self.store.write(at, json.dumps(texts | {dialect: sql}).encode())

    def view(self, namespace: str, name: str, dialect: str = "spark") -> str:
        return json.loads(self.store.read(f"{namespace}/_views/{name}.json"))[dialect]


#: Implementation classes of the catalogs' public connectors, which must be on the class path.
REMOTE = {
    "rest": {"type": "rest"}, "polaris": {"type": "rest", "header.X-Iceberg-Access-Delegation": "vended-credentials"}, "gravitino": {"type": "rest"},
    "unity": {"type": "rest"}, "nessie": {"catalog-impl": "org.apache.iceberg.nessie.NessieCatalog"}, "glue": {"catalog-impl": "org.apache.iceberg.aws.glue.GlueCatalog"}, "hive": {"type": "hive"},
}


def remote_settings(name: str, kind: str, uri: str = "", warehouse: str = "", credential: str = "", token: str = "", ref: str = "", sigv4: bool = False) -> dict[str, str]:
    """Spark settings that register a remote catalog under a name; requests are the connector's."""
    if kind not in REMOTE:
        raise ValueError(f"no such catalog: {kind}")
    at = f"spark.sql.catalog.{name}"
    out = {at: "org.apache.iceberg.spark.SparkCatalog", **{f"{at}.{k}": v for k, v in REMOTE[kind].items()}}
    given = {"uri": uri, "warehouse": warehouse, "credential": credential, "token": token, "ref": ref, "rest.sigv4-enabled": "true" if sigv4 else ""}
    return out | {f"{at}.{k}": v for k, v in given.items() if v}
