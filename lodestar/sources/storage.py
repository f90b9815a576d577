"""Paths of any store that Spark's file systems reach, and presets for object stores."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Storage:
    """Small metadata files under one root, through Hadoop's file systems."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.jvm = spark, root.rstrip("/"), spark._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.path("").getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def read(self, name: str) -> bytes:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def write_new(self, name: str, data: bytes) -> bool:
        """Writes a file that must not be there: by a temporary name and a rename that fails if it is."""
        import uuid

        target, draft = self.path(name), self.path(f"{name}.{uuid.uuid4().hex}.tmp")
        stream = self.fs.create(draft, True)
        stream.write(bytearray(data))
        stream.close()
        if self.exists(name):
            self.fs.delete(draft, False)
            return False
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri() if target.toUri().getScheme() else self.fs.getUri(), self.conf)
        none = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 1)
        none[0] = self.jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            context.rename(draft, target, none)
        except Exception as e:
            self.fs.delete(draft, False)
            if "FileAlreadyExists" in str(e):
                return False
            raise
        return True

    def write(self, name: str, data: bytes) -> None:
        stream = self.fs.create(self.path(name), True)
        stream.write(bytearray(data))
        stream.close()

    def list(self, name: str = "") -> list[tuple[str, int, int, bool]]:
        """(name, bytes, modified ms, whether a folder) of the entries, by name."""
        if not self.exists(name):
            return []
        return sorted((s.getPath().getName(), s.getLen(), s.getModificationTime(), s.isDirectory()) for s in self.fs.listStatus(self.path(name)))

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


#: Connector settings of S3-compatible services.
S3_SERVICES = {
    "minio": {"endpoint": "http://localhost:9000", "path_style": True}, "r2": {"endpoint": "https://{account}.r2.cloudflarestorage.com", "path_style": True},
    "b2": {"endpoint": "https://s3.{region}.backblazeb2.com", "path_style": False}, "wasabi": {"endpoint": "https://s3.{region}.wasabisys.com", "path_style": False},
    "digitalocean": {"endpoint": "https://{region}.digitaloceanspaces.com", "path_style": False},
}


def s3_settings(service: str | None = None, key: str = "", secret: str = "", region: str = "us-east-1", account: str = "") -> dict[str, str]:
    """Spark settings for s3a:// paths, of AWS or of a compatible service."""
    out = {"spark.hadoop.fs.s3a.access.key": key, "spark.hadoop.fs.s3a.secret.key": secret, "spark.hadoop.fs.s3a.endpoint.region": region}
    if service is not None:
        preset = S3_SERVICES[service]
        out |= {"spark.hadoop.fs.s3a.endpoint": preset["endpoint"].format(region=region, account=account), "spark.hadoop.fs.s3a.path.style.access": str(preset["path_style"]).lower()}
    return out


def azure_settings(account: str, key: str) -> dict[str, str]:
    return {f"spark.hadoop.fs.azure.account.key.{account}.dfs.core.windows.net": key}


def gcs_settings(project: str, keyfile: str) -> dict[str, str]:
    return {"spark.hadoop.fs.gs.project.id": project, "spark.hadoop.google.cloud.auth.service.account.json.keyfile": keyfile, "spark.hadoop.fs.gs.impl": "com.google.cloud.hadoop.fs.gcs.GoogleHadoopFileSystem"}
