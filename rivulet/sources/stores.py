"""Object stores of file inputs: their configuration as Hadoop settings.

Spark reads any store that Hadoop has a file system for; this maps credentials and endpoints to that file system's settings and
paths to its URIs. The connectors' jars (S3A, Google Cloud, Azure) come with the cluster.
"""

from __future__ import annotations

import base64

from pyspark.sql import SparkSession

from rivulet.errors import ConfigError


def needed(store: dict, *keys: str) -> list[str]:
    if missing := [k for k in keys if not store.get(k)]:
        raise ConfigError(f"a {store.get('type')} store needs {', '.join(missing)}")
    return [str(store[k]) for k in keys]


def s3(store: dict) -> dict[str, str]:
    bucket, key, secret = needed(store, "bucket_name", "access_key_id", "secret_access_key")
    own = f"fs.s3a.bucket.{bucket}"
    out = {f"{own}.access.key": key, f"{own}.secret.key": secret, f"{own}.connection.ssl.enabled": str(not store.get("allow_http", False)).lower()}
    if store.get("endpoint"):
        if store["endpoint"].startswith("http://") and not store.get("allow_http"):
            raise ConfigError("the endpoint is plain HTTP, which allow_http must permit")
        out |= {f"{own}.endpoint": store["endpoint"], f"{own}.path.style.access": "true"}
    if store.get("region"):
        out[f"{own}.endpoint.region"] = store["region"]
    return out


def gs(store: dict) -> dict[str, str]:
    needed(store, "bucket_name")
    path, key = store.get("service_account_path"), store.get("service_account_key")
    if (path is None) == (key is None):
        raise ConfigError("a gs store takes one of service_account_path and service_account_key")
    out = {"fs.gs.auth.type": "SERVICE_ACCOUNT_JSON_KEYFILE", "fs.gs.auth.service.account.json.keyfile": path} if path else {"fs.gs.auth.type": "SERVICE_ACCOUNT_JSON", "fs.gs.auth.service.account.json": key}
    return out | ({"fs.gs.storage.root.url": store["url"]} if store.get("url") else {})


def az(store: dict) -> dict[str, str]:
    account, _ = needed(store, "account", "container_name")
    out = {}
    if store.get("access_key"):
        try:
            base64.b64decode(store["access_key"], validate=True)
        except ValueError as e:
            raise ConfigError("access_key isn't base 64") from e
        out[f"fs.azure.account.key.{host(store)}"] = store["access_key"]
    return out


def host(store: dict) -> str:
    return str(store.get("endpoint") or store.get("url") or f"{store['account']}.dfs.core.windows.net").removeprefix("https://").rstrip("/")


def http(store: dict) -> dict[str, str]:
    (url,) = needed(store, "url")
    if not url.startswith(("http://", "https://")):
        raise ConfigError(f"no HTTP URL: {url}")
    return {"fs.http.impl": "org.apache.hadoop.fs.http.HttpFileSystem", "fs.https.impl": "org.apache.hadoop.fs.http.HttpsFileSystem"}


def hdfs(store: dict) -> dict[str, str]:
    (url,) = needed(store, "url")
    if not url.startswith("hdfs://"):
        raise ConfigError(f"no HDFS URL: {url}")
    return {str(k): str(v) for k, v in (store.get("ha_config") or {}).items()}


KINDS = {"s3": s3, "gs": gs, "az": az, "http": http, "hdfs": hdfs}


def settings(store: dict) -> dict[str, str]:
    """Hadoop settings of a store; a configuration that can't work is refused."""
    if store.get("type") not in KINDS:
        raise ConfigError(f"unknown store {store.get('type')!r}")
    return KINDS[store["type"]](store)


def location(store: dict, path: str) -> str:
    """URI of a path in the store; URIs stay as they are, but that s3 is spelled s3a."""
    settings(store)
    if "://" in path:
        return "s3a" + path[2:] if path.startswith("s3://") else path
    tail = path.lstrip("/")
    kind = store["type"]
    if kind == "s3":
        return f"s3a://{store['bucket_name']}/{tail}"
    if kind == "gs":
        return f"gs://{store['bucket_name']}/{tail}"
    if kind == "az":
        return f"abfss://{store['container_name']}@{host(store)}/{tail}"
    return f"{store['url'].rstrip('/')}/{tail}"


def use(spark: SparkSession, store: dict | None, path: str) -> str:
    """Put the store's settings on the session and give the path's URI."""
    if not store:
        return path
    conf = spark._jsc.hadoopConfiguration()
    for key, value in settings(store).items():
        conf.set(key, value)
    return location(store, path)
