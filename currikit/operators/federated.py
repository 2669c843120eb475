"""Server and client arithmetic on parameter tables.

A state is a table ``(key, pos, value)``; states of clients also have
``client_id``, weights are ``(client_id, sample_num)``. Each rule is one grouped
sum over the clients, with partial sums before the shuffle, and a map over the
joined global rows. Weights have a row a client; their table goes
to every task only through the optimizer's size check.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from currikit.functions import text as T

PLACE = ["key", "pos"]
#: Rules under which only A matrices are shared.
A_ONLY = ("fedavg", "fedavgm", "fedadagrad", "fedadgrad", "fedyogi", "fedadam", "scaffold", "fedprox")
ADAPTIVE = ("fedadagrad", "fedadgrad", "fedyogi", "fedadam")


@dataclass(frozen=True)
class Server:
    """Settings of the server's rule."""

    rule: str = "fedavg"
    uniform: bool = False
    beta1: float = 0.9
    beta2: float = 0.99
    eta: float = 1e-3
    tau: float = 1e-3
    clients: int = 1


def shared(rule: str) -> Column:
    """Whether a key takes part in the aggregation."""
    return T.is_lora_a(F.col("key")) if rule.lower() in A_ONLY else F.lit(True)


def client_weights(samples: DataFrame, uniform: bool = False) -> DataFrame:
    """``(client_id, w)``: equal, or by share of samples (of at least one in all)."""
    total = Window.partitionBy()
    n = F.count("*").over(total)
    w = 1.0 / n if uniform else F.col("sample_num") / F.greatest(F.sum("sample_num").over(total), F.lit(1))
    return samples.select("client_id", w.cast("double").alias("w"))


def weighted_sum(local: DataFrame, weights: DataFrame, value: Column | None = None) -> DataFrame:
    """``(key, pos, value)``: sum of weight times value over clients."""
    v = F.col("value") if value is None else value
    return local.join(weights, "client_id").groupBy(*PLACE).agg(F.sum(v * F.col("w")).alias("value"))


def mean_delta(state: DataFrame, local: DataFrame) -> DataFrame:
    """``(key, pos, delta)``: mean of local less global."""
    means = local.groupBy(*PLACE).agg(F.avg("value").alias("m"))
    return state.join(means, PLACE).select(*PLACE, (F.col("m") - F.col("value")).alias("delta"))


def initial_state(state: DataFrame, server: Server) -> DataFrame:
    """The optimizer's state before the first round: m = 0, and v = tau squared for adaptive rules, else null."""
    v = F.lit(server.tau**2) if server.rule in ADAPTIVE else F.lit(None).cast("double")
    return state.select(*PLACE, F.lit(0.0).alias("m"), v.alias("v"))


def initial_controls(state: DataFrame, clients: Sequence[int]) -> tuple[DataFrame, DataFrame]:
    """Control variates of the server and of each client, all 0."""
    zero = state.select(*PLACE, F.lit(0.0).alias("c"))
    return zero, zero.select(F.explode(F.array(*map(F.lit, clients))).alias("client_id"), *PLACE, "c")


def aggregate(state: DataFrame, local: DataFrame, samples: DataFrame, server: Server, round_: int = 0, optimizer: DataFrame | None = None) -> DataFrame:
    """The next global state ``(key, pos, value, m, v)`` by the server's rule.

    Keys that aren't shared, and every key in a round without clients, stay.
    fedavg, fedprox and any rule that isn't listed: the weighted sum. fedavgm: momentum on
    the weighted difference. fedadagrad, fedyogi, fedadam: an adaptive step on the
    plain mean of differences. Momentum starts with the difference itself in round 0.
    """
    optimizer = initial_state(state, server) if optimizer is None else optimizer
    weights = client_weights(samples, server.uniform)
    mine = local.where(shared(server.rule))
    sums = mine.join(weights, "client_id").groupBy(*PLACE).agg(F.sum(F.col("value") * F.col("w")).alias("__sum"), F.sum("w").alias("__w"), F.avg("value").alias("__mean"))
    rows = state.select(*PLACE, "value").join(optimizer.select(*PLACE, "m", "v"), PLACE, "left").join(sums, PLACE, "left")
    g, m, v = F.col("value"), F.col("m"), F.col("v")
    delta = F.col("__mean") - g if server.rule in ADAPTIVE else F.col("__sum") - g * F.col("__w")
    momentum = delta if round_ == 0 or server.rule in ("fedadagrad", "fedadgrad") else server.beta1 * m + (1 - server.beta1) * delta
    square = momentum * momentum
    second = {
        "fedadagrad": v + square,
        "fedadgrad": v + square,
        "fedyogi": v - (1 - server.beta2) * square * F.signum(v - square),
        "fedadam": server.beta2 * v + (1 - server.beta2) * square,
    }.get(server.rule, v)
    if server.rule in ADAPTIVE:
        stepped = g + server.eta * momentum / (F.sqrt(second) + server.tau)
    elif server.rule == "fedavgm":
        stepped = g + momentum
    else:
        stepped, momentum = F.col("__sum"), m
    takes = F.col("__sum").isNotNull() & shared(server.rule)
    pick = lambda new, old: F.when(takes, new).otherwise(old)
    return rows.select(*PLACE, pick(stepped, g).alias("value"), pick(momentum, m).alias("m"), pick(second, v).alias("v"))


def scaffold_server(control: DataFrame, deltas: DataFrame, clients: int) -> DataFrame:
    """The server's control variate plus the sum of the active clients' changes over the number of all clients."""
    sums = deltas.where(shared("scaffold")).groupBy(*PLACE).agg(F.sum("delta").alias("d"))
    return control.join(sums, PLACE, "left").select(*PLACE, (F.col("c") + F.coalesce("d", F.lit(0.0)) / clients).alias("c"))


def scaffold_client(state: DataFrame, local: DataFrame, control: DataFrame, own: DataFrame, steps: int, rate: float, a_only: bool = True) -> DataFrame:
    """``(client_id, key, pos, c, delta)``: each client's new control variate and its change; other keys keep theirs."""
    rows = local.join(state.withColumnRenamed("value", "g"), PLACE).join(control.withColumnRenamed("c", "c_all"), PLACE).join(own.withColumnRenamed("c", "c_own"), ["client_id", *PLACE])
    new = (F.col("g") - F.col("value")) / (steps * rate) - (F.col("c_all") - F.col("c_own"))
    takes = T.is_lora_a(F.col("key")) if a_only else F.lit(True)
    return rows.select("client_id", *PLACE, F.when(takes, new).otherwise(F.col("c_own")).alias("c"), F.when(takes, new - F.col("c_own")).otherwise(F.lit(0.0)).alias("delta"))


def prox_penalty(state: DataFrame, local: DataFrame, mu: float = 0.01, a_only: bool = True) -> DataFrame:
    """``(client_id, penalty)``: mu / 2 times the squared distance from the global state."""
    rows = local.where(T.is_lora_a(F.col("key"))) if a_only else local
    square = F.pow(F.col("value") - F.col("g"), 2)
    return rows.join(state.withColumnRenamed("value", "g"), PLACE).groupBy("client_id").agg((mu / 2 * F.sum(square)).alias("penalty"))


def trainer_of(rule: str) -> str:
    """Which local trainer goes with a rule."""
    if rule in ("fedprox", "scaffold"):
        return rule
    if rule in A_ONLY or rule.startswith("local"):
        return "plain"
    raise ValueError(f"unknown rule {rule}")


def export_b(state: DataFrame, local: DataFrame, samples: DataFrame) -> DataFrame:
    """The global state with B matrices as the sample-weighted mean over clients, whatever weights A has."""
    means = weighted_sum(local.where(T.is_lora_b(F.col("key"))), client_weights(samples)).withColumnRenamed("value", "b")
    return state.join(means, PLACE, "left").select(*PLACE, F.coalesce("b", "value").alias("value"))


def fuse(state: DataFrame, local: DataFrame, how: str = "global_a") -> DataFrame:
    """Clients' next states: ``global_a`` takes A from the global state where it has it; ``local`` and ``global`` keep one whole."""
    if how == "local":
        return local.select("client_id", *PLACE, "value")
    if how == "global":
        return local.select("client_id").distinct().crossJoin(state.select(*PLACE, "value"))  # each client gets the whole state
    if how != "global_a":
        raise ValueError(f"unknown way to fuse: {how}")
    g = state.select(*PLACE, F.col("value").alias("g"))
    value = F.when(T.is_lora_a(F.col("key")) & F.col("g").isNotNull(), F.col("g")).otherwise(F.col("value"))
    return local.join(g, PLACE, "left").select("client_id", *PLACE, value.alias("value"))


def client_init(state: DataFrame, local: DataFrame, prefer_local_a: bool = False) -> DataFrame:
    """Clients' first states: A global (or their own), B their own, other keys global where there are any."""
    g = state.select(*PLACE, F.col("value").alias("g"))
    a, b = T.is_lora_a(F.col("key")), T.is_lora_b(F.col("key"))
    value = F.when(a, F.col("value") if prefer_local_a else F.col("g")).when(b, F.col("value")).otherwise(F.coalesce("g", "value"))
    return local.join(g, PLACE, "left").select("client_id", *PLACE, value.alias("value"))


def tensor_counts(local: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """``(client_id, n_a, n_b, n_replaced)``: A and B tensors of each client, and A tensors that the state has too."""
    keys = local.select("client_id", "key").distinct()
    have = state.select("key").distinct().withColumn("__has", F.lit(True)) if state is not None else None
    keys = keys.join(have, "key", "left") if have is not None else keys.withColumn("__has", F.lit(None).cast("boolean"))
    a = T.is_lora_a(F.col("key"))
    return keys.groupBy("client_id").agg(F.count_if(a).alias("n_a"), F.count_if(T.is_lora_b(F.col("key"))).alias("n_b"), F.count_if(a & F.col("__has").isNotNull()).alias("n_replaced"))


def cosine_a(state: DataFrame, local: DataFrame, eps: float = 1e-12) -> DataFrame:
    """``(client_id, cosine, n)``: one cosine over all A parameters that both have; clients with none have 0 and 0."""
    rows = local.where(T.is_lora_a(F.col("key"))).join(state.withColumnRenamed("value", "g"), PLACE)
    g, x = F.col("g"), F.col("value")
    sums = rows.groupBy("client_id").agg(F.sum(g * x).alias("d"), F.sum(g * g).alias("gg"), F.sum(x * x).alias("xx"), F.count_distinct("key").alias("n"))
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("d") / F.greatest(F.sqrt(F.col("gg") * F.col("xx")), F.lit(eps))))
    clients = local.select("client_id").distinct()
    return clients.join(sums, "client_id", "left").select("client_id", F.coalesce(cosine, F.lit(0.0)).alias("cosine"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def align_keys(targets: DataFrame, sources: DataFrame) -> DataFrame:
    """``(key, source_key, tier)``: for each target the same source key, else that of the same suffix from a marker (the last in order), else the first of which either ends with the other.

    ``sources`` has ``(key, ordinal)``. The first two tiers are equi-joins. For the third, every
    ending of a key is a key of its own, so it is two more equi-joins and not a
    comparison of all with all. Targets that nothing matches are left out.
    """
    s = sources.select(F.col("key").alias("source_key"), "ordinal")
    exact = s.select(F.col("source_key").alias("key"), "source_key", F.lit(1).alias("tier"), F.lit(0).alias("at"))
    by_suffix = s.withColumn("suffix", T.suffix_from_marker(F.col("source_key"))).groupBy("suffix").agg(F.max_by("source_key", "ordinal").alias("source_key"))
    marked = targets.select("key", T.suffix_from_marker(F.col("key")).alias("suffix"))
    suffix = marked.join(by_suffix, "suffix").select("key", "source_key", F.lit(2).alias("tier"), F.lit(0).alias("at"))
    endings = lambda c: F.explode(F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.substring(c, i, F.length(c))))
    longer = targets.select("key", endings(F.col("key")).alias("end")).join(s.withColumn("end", F.col("source_key")), "end")
    shorter = s.select("source_key", "ordinal", endings(F.col("source_key")).alias("end")).join(targets.withColumn("end", F.col("key")), "end")
    ends = longer.select("key", "source_key", "ordinal").union(shorter.select("key", "source_key", "ordinal"))
    third = ends.select("key", "source_key", F.lit(3).alias("tier"), F.col("ordinal").cast("int").alias("at"))
    found = exact.join(targets.select("key"), "key").unionByName(suffix).unionByName(third)
    return found.groupBy("key").agg(F.min_by(F.struct("source_key", "tier"), F.struct("tier", "at")).alias("b")).select("key", "b.*")


def train_stats(steps: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """``(client_id, metrics, num_steps)``: means over each client's steps."""
    return steps.groupBy("client_id").agg(*(F.avg(m).alias(m) for m in metrics), F.count("*").alias("num_steps"))
