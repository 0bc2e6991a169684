"""HTTP calls of client methods: what each strategy finds, the first strategy that finds something, hits lent by overloads and implementations, overloads as one.

A hit is (method_id, verb, route, strategy, confidence); methods are (method_id, project_id, project_name, seq, owner_id, owner, owner_kind class or interface, base_types, method, return_type, n_params,
calls_own_name), seq their order in the source. Methods without a hit have no row among hits. Ties in seq go to the least method_id. Nulls: a null list is an empty one, a null name matches nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.routes import combine_routes, is_route_like, normalize_route, verb_of_method
from .graph import written

#: Calls that look like HTTP calls and are none, the wait types, and strategies from the first to be asked to the last.
NO_RECEIVERS = ("Path", "File", "Directory", "Environment")
NO_CALLS = ("GetSection", "GetValue", "GetConnectionString")
STRATEGIES = ("refit", "generated", "configured-wrapper", "generic-http")
WAITS = r"^(Task|ValueTask)(<|$)"
#: Longest piece of a glob's literal text by which it is found.
GRAM = 4


def _hit(verb: Column, route: Column, strategy: str, confidence: int) -> list[Column]:
    return [verb.alias("verb"), route.alias("route"), F.lit(strategy).alias("strategy"), F.lit(confidence).alias("confidence")]


def generic_hits(calls: DataFrame, methods: DataFrame) -> DataFrame:
    """The first of a method's calls (method_id, seq, kind request or invocation, receiver, called, verb, args array<string> with nulls for what isn't static) that has a verb and a route: a request
    gives both, an invocation's name gives the verb and its first route-like argument the route. Calls of own overloads, of known other receivers and names are passed over."""
    named = calls.join(methods.select("method_id", "method"), "method_id")
    request = F.col("kind") == "request"
    route = F.when(request, F.get("args", F.lit(1))).otherwise(F.get(F.filter("args", lambda a: F.coalesce(is_route_like(a), F.lit(False))), F.lit(0)))
    verb = F.when(request, F.col("verb")).otherwise(verb_of_method(F.col("called")))
    other = F.coalesce(F.col("called").isin(*NO_CALLS) | F.substring_index("receiver", ".", -1).isin(*NO_RECEIVERS), F.lit(False))
    own = F.col("receiver").isNull() & (F.col("called") == F.col("method"))
    found = named.filter(request | (~other & ~own)).select("method_id", "seq", verb.alias("verb"), route.alias("route")).filter("verb is not null and route is not null").filter(is_route_like(F.col("route")))
    first = found.groupBy("method_id").agg(F.min_by(F.struct("verb", "route"), F.struct("seq", "verb", "route")).alias("h"))
    return first.select("method_id", *_hit(F.col("h.verb"), F.col("h.route"), "generic-http", 1))


def _grams(text: Column, sizes: Column) -> Column:
    """All pieces of a text of the sizes."""
    fit = F.filter(sizes, lambda k: k <= F.length(text))
    return F.flatten(F.transform(fit, lambda k: F.transform(F.sequence(F.lit(1), F.length(text) - k + 1), lambda i: F.substring(text, i, k))))


def match_globs(texts: DataFrame, globs: DataFrame) -> DataFrame:
    """(text, pattern) of distinct texts (text) that globs (pattern) match, anchored and in any case. A glob without wildcards is found by its whole text. Any other is found by the piece of its literal runs, of GRAM letters where a run has
    as many, that the fewest texts hold, as each text that it matches holds them all; so texts and globs that share a common beginning don't meet. Globs without literal letters meet all texts, as they match nearly all."""
    low = texts.select("text").filter("text is not null").distinct().withColumn("low", F.lower("text"))
    sizes = F.sequence(F.lit(1), F.lit(GRAM))
    pieces = low.select("text", F.explode(F.array_distinct(F.concat(_grams(F.col("low"), sizes), F.array(F.lit(""), F.concat(F.lit("="), "low"))))).alias("gram"))
    held = pieces.groupBy("gram").agg(F.count(F.lit(1)).alias("held"))
    runs = F.filter(F.split(F.lower("pattern"), "[*?]+"), lambda s: s != "")
    longest = F.coalesce(F.array_max(F.transform(runs, lambda r: F.length(r))), F.lit(0))
    size = F.array(F.least(longest, F.lit(GRAM)))
    asked = F.when(~F.col("pattern").rlike("[*?]"), F.array(F.concat(F.lit("="), F.lower("pattern")))).when(longest == 0, F.array(F.lit(""))).otherwise(F.flatten(F.transform(runs, lambda r: _grams(r, size))))
    keys = globs.select("pattern").distinct().select("pattern", F.explode(F.array_distinct(asked)).alias("gram"))
    rarest = keys.join(held, "gram", "left").groupBy("pattern").agg(F.min_by("gram", F.struct(F.coalesce("held", F.lit(0)), "gram")).alias("gram"))
    pairs = pieces.join(rarest, "gram")
    meta = F.regexp_replace("pattern", r"([^\p{L}\p{N}*?])", r"\\$1")
    regex = F.concat(F.lit("(?is)^"), F.replace(F.replace(meta, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit("$"))
    return pairs.filter(F.rlike("text", regex)).select("text", "pattern")


def wrapper_hits(calls: DataFrame, rules: DataFrame) -> DataFrame:
    """Hits of configured rules (rule_order, type_glob, methods array<struct<glob, verb>>, route_argument): of a method's invocations (method_id, seq, receiver_types array<string>, called, args) the first, and of the rules the first
    that fit a receiver type (without its type arguments) and the called name and find a static route in their argument. Globs meet distinct types and distinct names, not calls; a call meets the rules of its type and name."""
    listed = rules.select("rule_order", "type_glob", "route_argument", F.posexplode("methods").alias("place", "m")).select("rule_order", "type_glob", "route_argument", "place", F.col("m.glob").alias("glob"), F.upper("m.verb").alias("rule_verb"))
    asked = calls.filter("kind = 'invocation'").select("method_id", "seq", "called", "args", F.explode(F.transform("receiver_types", lambda t: F.substring_index(t, "<", 1))).alias("type_name"))
    shapes = asked.select("type_name", "called").distinct()
    types = match_globs(shapes.select(F.col("type_name").alias("text")), listed.select(F.col("type_glob").alias("pattern"))).toDF("type_name", "type_glob")
    names = match_globs(shapes.select(F.col("called").alias("text")), listed.select(F.col("glob").alias("pattern"))).toDF("called", "glob")
    fits = shapes.join(types, "type_name").join(listed, "type_glob").join(names, ["called", "glob"])
    one = fits.groupBy("type_name", "called", "rule_order", "route_argument").agg(F.min_by("rule_verb", "place").alias("rule_verb"))  # a rule's first name that fits
    ready = one.filter("rule_verb is not null").groupBy("type_name", "called").agg(F.array_sort(F.collect_list(F.struct("rule_order", "rule_verb", "route_argument"))).alias("rules"))
    chosen = F.get(F.filter("rules", lambda r: F.get(F.col("args"), r["route_argument"]).isNotNull()), F.lit(0))
    found = asked.join(ready, ["type_name", "called"]).withColumn("r", chosen).filter("r is not null")
    first = found.groupBy("method_id").agg(F.min_by(F.struct(F.col("r.rule_verb").alias("verb"), F.get("args", F.col("r.route_argument")).alias("route")), F.struct("seq", "r.rule_order")).alias("h"))
    return first.select("method_id", *_hit(F.col("h.verb"), F.col("h.route"), "configured-wrapper", 2))


def generated_hits(bodies: DataFrame) -> DataFrame:
    """Hits of generated clients (method_id, method, verb, path_comment, appends array<struct<value, is_base>>, template): with a request's verb, the path that a comment gives, else the appended parts in order without those of the base url,
    {} for what isn't static; else, with the verb in the method's name, the owner's template without its base and query."""
    parts = F.transform(F.filter("appends", lambda a: ~F.coalesce(a["is_base"], F.lit(False))), lambda a: F.coalesce(a["value"], F.lit("{}")))
    built = F.when(F.col("verb").isNotNull(), F.coalesce("path_comment", F.when(F.size(parts) > 0, F.array_join(parts, ""))))
    by_name = verb_of_method(F.col("method"))
    plain = F.regexp_replace(F.replace("template", F.lit("{+baseurl}"), F.lit("")), r"\{\?[^}]*\}", "")
    templated = F.when(F.col("template").contains("{+baseurl}") & by_name.isNotNull(), plain)
    found = bodies.select("method_id", F.when(built.isNotNull(), F.upper("verb")).otherwise(by_name).alias("_verb"), F.coalesce(built, templated).alias("_route")).filter("_route is not null")
    return found.select("method_id", *_hit(F.col("_verb"), F.col("_route"), "generated", 2))


def first_strategy(*found: DataFrame) -> DataFrame:
    """One hit for each method: that of the first of STRATEGIES that has one."""
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    rank = F.array_position(F.array(*map(F.lit, STRATEGIES)), F.col("strategy"))
    return every.groupBy("method_id").agg(F.min_by(F.struct("verb", "route", "strategy", "confidence"), F.struct(rank, "verb", "route")).alias("h")).select("method_id", "h.*")


def lend_hits(methods: DataFrame, hits: DataFrame) -> DataFrame:
    """hits with those that methods take over: one of a class that calls its own name takes the hit of the first overload of its owner that has one; then one of an interface that of a class of its project that lists
    the interface and has a method of its name with a hit, with as many parameters if there is such, the first in the source if there are several. The first holder of each key is chosen before it meets those who ask, so no join has all pairs of a name."""
    hits = written(hits)  # read many times below
    hit = F.struct("verb", "route", "strategy", "confidence")
    order = F.struct("seq", "method_id")
    with_hits = methods.join(hits, "method_id")
    lonely = methods.join(hits.select("method_id"), "method_id", "left_anti")
    overload = with_hits.groupBy("owner_id", "method").agg(F.min_by(hit, order).alias("h"))
    taken = lonely.filter("owner_kind = 'class' and calls_own_name").join(overload, ["owner_id", "method"]).select("method_id", "h.*")
    known = hits.unionByName(written(taken))
    classes = methods.filter("owner_kind = 'class'").join(known, "method_id")
    lenders = classes.select("*", F.explode(F.array_distinct(F.transform("base_types", lambda b: F.substring_index(b, "<", 1)))).alias("face"))
    by_count = lenders.groupBy("project_id", "face", "method", "n_params").agg(F.min_by(hit, order).alias("same"))
    by_name = lenders.groupBy("project_id", "face", "method").agg(F.min_by(hit, order).alias("any"))
    asking = lonely.filter("owner_kind = 'interface'").select("method_id", "project_id", F.col("owner").alias("face"), "method", "n_params")
    lent = asking.join(by_name, ["project_id", "face", "method"]).join(by_count, ["project_id", "face", "method", "n_params"], "left").select("method_id", F.coalesce("same", "any").alias("h")).select("method_id", "h.*")
    return known.unionByName(lent)


def collapse_overloads(methods: DataFrame, hits: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(id, method_id, project_id, seq, verb, route, norm, strategy, confidence) of client methods: those with a hit, and of the others the ones that wait and whose owner has some hit. Methods of one id are taken in the order of the source: each verb and
    route once; one without a hit only where nothing holds the id, and a later hit takes its place. So of an id with hits what is left are its distinct verbs and routes by their first method, the first on the place of a waiting method before it,
    and of an id without hits its first waiting method; which is a grouping, not a fold. prefixes (project_name, prefix) lead the routes of their projects."""
    hits = written(hits)
    base = F.concat(F.lit("cm:"), F.col("project_name"), F.lit(":"), F.col("owner"), F.lit("."), F.col("method"))
    held = methods.join(hits.select("method_id", "verb", "route", "strategy", "confidence"), "method_id", "left").join(prefixes, "project_name", "left")
    owners = methods.join(hits.select("method_id"), "method_id", "left_semi").select("owner_id").distinct()
    led = F.when(F.col("prefix").isNull(), combine_routes(F.lit(None).cast("string"), F.col("route"))).otherwise(combine_routes(F.col("prefix"), F.ltrim("route", F.lit("/"))))
    row = held.select("method_id", "project_id", "owner_id", "seq", base.alias("id"), "verb", F.when(F.col("verb").isNotNull(), led).alias("route"), F.coalesce("strategy", F.lit("none")).alias("strategy"), F.coalesce("confidence", F.lit(0)).alias("confidence"), "return_type")
    row = row.withColumn("norm", F.when(F.col("verb").isNotNull(), normalize_route(F.col("route"))))
    order = F.struct("seq", "method_id")
    fields = F.struct("method_id", "seq", "verb", "route", "norm", "strategy", "confidence")
    key = ["project_id", "id"]
    waiting = row.filter(F.col("verb").isNull() & F.col("return_type").rlike(WAITS)).join(owners, "owner_id", "left_semi").groupBy(*key).agg(F.min_by(fields, order).alias("wait"))
    called = row.filter("verb is not null").groupBy(*key, F.lower("verb").alias("v"), "norm").agg(F.min_by(fields, order).alias("n")).select(*key, "n.*")
    ranked = called.withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy("seq", "method_id")))
    first = ranked.join(waiting, key, "left").withColumn("seq", F.when(F.col("place") == 1, F.least("seq", F.coalesce("wait.seq", "seq"))).otherwise(F.col("seq"))).drop("wait")
    alone = waiting.join(called.select(*key).distinct(), key, "left_anti").select(*key, "wait.*", F.lit(1).alias("place"))
    out = first.unionByName(alone).withColumn("id", F.when(F.col("place") == 1, F.col("id")).otherwise(F.concat("id", F.lit("#"), F.col("place").cast("string"))))
    return out.select("id", "method_id", "project_id", "seq", "verb", "route", "norm", "strategy", "confidence")
