"""Routes of endpoints: what a class takes from its bases, routes of controller methods and of mapped handlers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.routes import combine_routes, normalize_route, replace_tokens
from .graph import written


def base_links(classes: DataFrame) -> DataFrame:
    """(class_id, base_id): for each of classes (class_id, project_id, name, seq, bases array<string>) the first of its bases that its project declares; of a name declared twice the first in the source."""
    first = classes.groupBy("project_id", "name").agg(F.min_by("class_id", F.struct("seq", "class_id")).alias("base_id"))
    plain = F.transform("bases", lambda b: F.substring_index(F.substring_index(b, "<", 1), ".", -1))
    named = classes.select("class_id", "project_id", F.posexplode(plain).alias("place", "name")).join(first, ["project_id", "name"])
    return named.groupBy("class_id").agg(F.min_by("base_id", "place").alias("base_id"))


def class_routes(classes: DataFrame) -> DataFrame:
    """(class_id, class_route, controller) of classes (..., own_route, is_controller): the route of the nearest class that has one, itself first, and whether it or one of its bases is a controller. Pointers double: a round
    joins each class that still asks with what its pointer knows, so a chain of n bases takes log2(n) rounds; a class has asked enough when its pointer ended, when it knows both, or when it has seen as many as its project has, which is
    what ends cycles."""
    links = base_links(classes)
    size = classes.groupBy("project_id").agg(F.count(F.lit(1)).alias("size"))
    state = classes.join(links, "class_id", "left").join(size, "project_id").select("class_id", F.col("own_route").alias("class_route"), F.coalesce("is_controller", F.lit(False)).alias("controller"), F.col("base_id").alias("next"), "size")
    seen = 1
    while True:
        state = written(state)
        asks = F.col("next").isNotNull() & (F.col("class_route").isNull() | ~F.col("controller")) & (F.col("size") > seen)
        if state.filter(asks).isEmpty():
            return state.select("class_id", "class_route", "controller")
        known = state.select(F.col("class_id").alias("next"), F.col("class_route").alias("far_route"), F.col("controller").alias("far_controller"), F.col("next").alias("far_next"))
        grown = state.filter(asks).join(known, "next", "left")
        grown = grown.select("class_id", F.coalesce("class_route", "far_route").alias("class_route"), (F.col("controller") | F.coalesce("far_controller", F.lit(False))).alias("controller"), F.col("far_next").alias("next"), "size")
        state = state.filter(~asks).unionByName(grown)
        seen *= 2


def controller_endpoints(methods: DataFrame, classes: DataFrame) -> DataFrame:
    """(method_id, verb, route, norm, handler) of methods (method_id, class_id, method, verb, template, method_route) of controllers that are not abstract: the class's route, then the verb's template or else the method's own, with
    [controller] and [action] of the class that has the method."""
    held = methods.join(class_routes(classes), "class_id").join(classes.select("class_id", F.col("name").alias("class_name"), "is_abstract"), "class_id").filter("controller and not coalesce(is_abstract, false)")
    put = lambda c: replace_tokens(c, F.col("class_name"), F.col("method"))
    route = combine_routes(put(F.col("class_route")), put(F.coalesce("template", "method_route")))
    return held.select("method_id", "verb", route.alias("route"), normalize_route(route).alias("norm"), F.concat_ws(".", "class_name", "method").alias("handler"))


def mapped_endpoints(maps: DataFrame) -> DataFrame:
    """(map_id, verb, route, norm) of mapped handlers (map_id, verb, prefix or null, template): inside a group a leading slash is relative to the group's prefix."""
    template = F.when(F.col("prefix").isNull(), F.col("template")).otherwise(F.ltrim("template", F.lit("/")))
    route = combine_routes(F.col("prefix"), template)
    return maps.filter("template is not null").select("map_id", "verb", route.alias("route"), normalize_route(route).alias("norm"))
