"""Lookups: applications by domain, upload rules by extension, providers by model, domain lists against each other."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def suffixes(host: Column) -> Column:
    """The host and every part of it after a dot: a.b.c -> a.b.c, b.c, c."""
    parts = F.split(F.lower(F.trim(host)), "[.]")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def application_rows(p: dict, spark) -> DataFrame:
    """app_ord, domain_ord, id, domain, enabled, upload, connect_proxy: a row for each domain of each application of a policy."""
    rows = [(n, k, a["id"], d.lower(), a.get("enabled", True), a.get("upload", True), a.get("connect_proxy", False)) for n, a in enumerate(p["applications"]) for k, d in enumerate(a["domains"])]
    return spark.createDataFrame(rows, "app_ord int, domain_ord int, id string, domain string, enabled boolean, upload boolean, connect_proxy boolean")


def resolve_application(hosts: DataFrame, applications: DataFrame, host: str = "host") -> DataFrame:
    """Each host row with app_id: the first application one of whose domains is the host or a parent of it.

    An equi-join over the few suffixes of each distinct host, not a comparison of every host with every domain.
    """
    names = hosts.select(F.col(host).alias("_host")).where("_host is not null").distinct()
    found = names.select("_host", F.explode(suffixes(F.col("_host"))).alias("domain")).join(applications, "domain").groupBy("_host").agg(F.min_by("id", F.struct("app_ord", "id")).alias("app_id"))
    return hosts.join(found, hosts[host] == found["_host"], "left").drop("_host")


def in_domains(hosts: DataFrame, domains: DataFrame, host: str = "host") -> DataFrame:
    """Rows whose host is one of the domains or below one."""
    names = hosts.select(F.col(host).alias("_host")).where("_host is not null").distinct()
    hit = names.select("_host", F.explode(suffixes(F.col("_host"))).alias("domain")).join(domains.select(F.lower(F.trim("domain")).alias("domain")), "domain", "left_semi").select("_host").distinct()
    return hosts.join(hit, hosts[host] == hit["_host"], "left_semi")


def domain_changes(desired: DataFrame, builtin: DataFrame, registered: DataFrame) -> DataFrame:
    """domain, change: to add (wanted, neither built in nor there yet) or to remove (there, no longer wanted)."""
    add = desired.join(builtin, "domain", "left_anti").join(registered, "domain", "left_anti").select("domain", F.lit("add").alias("change"))
    gone = registered.join(desired, "domain", "left_anti").select("domain", F.lit("remove").alias("change"))
    return add.union(gone).distinct()


def enabled_domains(applications: DataFrame, proxied: bool = False, most: int | None = None) -> DataFrame:
    """Domains of the enabled applications in the order of the policy; at most so many, the first, if asked."""
    rows = applications.where(F.col("enabled") & (F.col("connect_proxy") if proxied else F.lit(True))).select("app_ord", "domain_ord", "domain").orderBy("app_ord", "domain_ord")
    return rows if most is None else rows.limit(most)


def upload_action(extension: Column, uploads: dict[str, str]) -> Column:
    """allow, inspect or block, by the extension without leading dots in lower case; inspect if nothing is said."""
    key = F.lower(F.ltrim(extension, F.lit(".")))
    return reduce(lambda acc, kv: acc.when(key == kv[0].lstrip(".").lower(), F.lit(kv[1])), uploads.items(), F.when(F.lit(False), F.lit(""))).otherwise(F.lit("inspect"))


# How model names tell the provider; the first that fits counts ("^" stands for a beginning).
PROVIDERS = [
    ("openai", ["^gpt", "^o1", "^o3"]),
    ("anthropic", ["^claude"]),
    ("gemini", ["^gemini"]),
    ("grok", ["^grok"]),
    ("perplexity", ["^sonar", "perplexity"]),
    ("deepseek", ["^deepseek"]),
    ("mistral", ["^mistral", "^pixtral", "^codestral"]),
    ("cohere", ["^command", "^cohere"]),
    ("openrouter", ["openrouter"]),
    ("ollama", ["^llama", "ollama"]),
]


def provider(header: Column, model: Column) -> Column:
    """The header in lower case if there is one, else by the model's name, else openai."""
    name = F.lower(F.coalesce(model, F.lit("")))
    out = F.when(header.isNotNull(), F.lower(header))
    for who, marks in PROVIDERS:
        fits = [F.startswith(name, F.lit(m[1:])) if m[0] == "^" else F.contains(name, F.lit(m)) for m in marks]
        out = out.when(reduce(lambda a, b: a | b, fits), F.lit(who))
    return out.otherwise(F.lit("openai"))


def tool_decision(tool: Column, denied: list[str], allowed: list[str]) -> Column:
    """Block for a denied tool, and for one that a list of allowed tools does not name; names may end in .*"""

    def one_of(names: list[str]) -> Column:
        return reduce(lambda a, b: a | b, [F.startswith(tool, F.lit(n[:-1])) if n.endswith(".*") else tool == n for n in names], F.lit(False))

    block = one_of(denied) | (~one_of(allowed) if allowed else F.lit(False))
    return F.when(block, F.lit("Block")).otherwise(F.lit("Allow"))
