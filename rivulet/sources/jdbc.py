"""Addresses of databases as JDBC takes them."""

from __future__ import annotations

from urllib.parse import unquote, urlsplit

from rivulet.errors import ConfigError

#: Schemes of addresses and JDBC's names of the same databases.
SCHEMES = {"mysql": "mysql", "mariadb": "mariadb", "postgres": "postgresql", "postgresql": "postgresql"}
FILES = ("sqlite", "duckdb")


def address(uri: str) -> tuple[str, dict[str, str]]:
    """JDBC URL and properties of an address such as mysql://user:password@host:3306/name; a JDBC URL stays as it is."""
    if uri.startswith("jdbc:"):
        return uri, {}
    scheme, _, rest = uri.partition(":")
    if scheme in FILES:
        return f"jdbc:{scheme}:{rest.removeprefix('//')}", {}
    if scheme not in SCHEMES:
        raise ConfigError(f"no database address: {uri.partition('@')[0].partition('://')[0]}://...")
    parts = urlsplit(uri)
    if not parts.hostname:
        raise ConfigError(f"a {scheme} address has no host")
    port, query = f":{parts.port}" if parts.port else "", f"?{parts.query}" if parts.query else ""
    who = {k: unquote(v) for k, v in (("user", parts.username), ("password", parts.password)) if v}
    return f"jdbc:{SCHEMES[scheme]}://{parts.hostname}{port}{parts.path}{query}", who
