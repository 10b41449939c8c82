"""A graph of senses: words, forms, senses and pointers between them, as tables.

sense (word, pos, sense_no, synset), form (word, pos, base), pointer (src, ptr, dst); ptr is @ for a broader sense, ~ for a
narrower, % and # with a letter for parts and wholes, ! for an opposite.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkwarp.operators.networks import closure
from inkwarp.session import settle

#: Kinds of neighbours: broader, narrower, parts, wholes.
AROUND = ("@", "~", "%", "#")


def lookup(words: DataFrame, sense: DataFrame, form: DataFrame, number: int | None = None) -> DataFrame:
    """(word, pos, sense_no, synset) of words (word, pos): their senses, or where the index has none those of their base forms, and so on (GR-01). number: of the senses found, the one of this place."""
    at = settle(words.select("word", "pos", F.col("word").alias("now")).distinct())
    found, seen = None, at
    index = sense.select(F.col("word").alias("now"), "pos", "sense_no", "synset")
    while not at.isEmpty():
        hit = at.join(index, ["now", "pos"])
        found = hit if found is None else found.unionByName(hit)
        miss = at.join(index.select("now", "pos").distinct(), ["now", "pos"], "left_anti")
        step = miss.join(form.select(F.col("word").alias("now"), "pos", "base"), ["now", "pos"]).select("word", "pos", F.col("base").alias("now")).distinct()
        at = settle(step.join(seen, ["word", "pos", "now"], "left_anti"))
        seen = seen.unionByName(at)
    found = found if found is not None else words.limit(0).join(index.withColumnRenamed("now", "word"), ["word", "pos"])
    found = found.select("word", "pos", "sense_no", "synset").distinct()
    if number is None:
        return found
    place = F.row_number().over(Window.partitionBy("word", "pos").orderBy("sense_no", "synset"))
    return found.withColumn("place", place).filter(F.col("place") == number).drop("place")


def familiarity(sense: DataFrame) -> DataFrame:
    """(word, pos, n): how many senses a word has (GR-02)."""
    return sense.groupBy("word", "pos").agg(F.count("*").alias("n"))


def reverse_forms(form: DataFrame) -> DataFrame:
    """(base, pos, words): the forms of each base word, in order (GR-02)."""
    return form.groupBy("base", "pos").agg(F.array_join(F.array_sort(F.collect_set("word")), ",").alias("words"))


def beginning(sense: DataFrame, prefix: str) -> DataFrame:
    """(word): indexed words that begin with a prefix, whatever its case (GR-02)."""
    return sense.filter(F.lower("word").startswith(prefix.lower())).select("word").distinct()


def pointed(pointer: DataFrame, kind: str, of: DataFrame | None = None) -> DataFrame:
    """(src, dst): what senses point to by a kind of pointer, with any letters after it (GR-03); of (synset): only from these."""
    found = pointer.filter(F.col("ptr").startswith(kind)).select("src", "dst").distinct()
    return found if of is None else found.join(of.select(F.col("synset").alias("src")).distinct(), "src", "left_semi")


def with_pointers(pointer: DataFrame, new: DataFrame) -> DataFrame:
    """Pointers with new ones (src, ptr, dst), each once (GR-03)."""
    return pointer.select("src", "ptr", "dst").union(new.select("src", "ptr", "dst")).distinct()


def without_pointers(pointer: DataFrame, old: DataFrame) -> DataFrame:
    """Pointers without some (GR-03)."""
    return pointer.join(old.select("src", "ptr", "dst").distinct(), ["src", "ptr", "dst"], "left_anti")


def with_senses(sense: DataFrame, new: DataFrame) -> DataFrame:
    """The index with new senses (word, pos, synset) after those that their words have, in order of synset; what is there already isn't added (GR-04)."""
    new = new.select("word", "pos", "synset").distinct().join(sense, ["word", "pos", "synset"], "left_anti")
    last = sense.groupBy("word", "pos").agg(F.max("sense_no").alias("last"))
    place = F.row_number().over(Window.partitionBy("word", "pos").orderBy("synset"))
    numbered = new.withColumn("place", place).join(last, ["word", "pos"], "left").select("word", "pos", (F.col("place") + F.coalesce("last", F.lit(0))).cast("int").alias("sense_no"), "synset")
    return sense.select("word", "pos", "sense_no", "synset").unionByName(numbered)


def without_senses(sense: DataFrame, pointer: DataFrame, old: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sense, pointer) without synsets (synset) and what points from or to them (GR-04)."""
    gone = old.select("synset").distinct()
    left = pointer.join(gone.withColumnRenamed("synset", "src"), "src", "left_anti").join(gone.withColumnRenamed("synset", "dst"), "dst", "left_anti")
    return sense.join(gone, "synset", "left_anti"), left.select("src", "ptr", "dst")


def traverse(pointer: DataFrame, kind: str, start: DataFrame | None = None) -> DataFrame:
    """(node, ancestor, depth): all that is reached from senses by one kind of pointer, each once at its least depth (GR-05)."""
    nodes = None if start is None else start.select(F.col("synset").alias("node"))
    return closure(pointed(pointer, kind).toDF("child", "parent"), nodes).filter("depth > 0")


def before(pointer: DataFrame, kind: str, target: DataFrame, start: DataFrame) -> DataFrame:
    """(synset, before): for target senses, the senses reached from start that point to them (GR-05)."""
    reached = traverse(pointer, kind, start).select(F.col("ancestor").alias("src")).union(start.select("synset")).distinct()
    return pointed(pointer, kind).join(reached, "src", "left_semi").join(target.select(F.col("synset").alias("dst")).distinct(), "dst", "left_semi").select(F.col("dst").alias("synset"), F.col("src").alias("before"))


def coordinates(pointer: DataFrame) -> DataFrame:
    """(synset, coordinate): the narrower senses of a sense's first broader one (the least), itself among them (GR-05)."""
    first = pointed(pointer, "@").groupBy("src").agg(F.min("dst").alias("up"))
    return first.join(pointed(pointer, "~").toDF("up", "coordinate"), "up").select(F.col("src").alias("synset"), "coordinate")


def distance(pointer: DataFrame, kind: str, pairs: DataFrame) -> DataFrame:
    """(a, b, distance): steps by one kind of pointer from a to b, the least there are, 0 where b isn't reached (GR-06)."""
    up = traverse(pointer, kind, pairs.select(F.col("a").alias("synset"))).select(F.col("node").alias("a"), F.col("ancestor").alias("b"), "depth")
    return pairs.select("a", "b").distinct().join(up, ["a", "b"], "left").select("a", "b", F.coalesce("depth", F.lit(0)).alias("distance"))


def surroundings(pointer: DataFrame) -> DataFrame:
    """(src, dst, kind): neighbours of the four kinds in AROUND (GR-07)."""
    names = dict(zip(AROUND, ("hyper", "hypo", "mero", "holo"), strict=True))
    found = None
    for k in AROUND:
        one = pointed(pointer, k).withColumn("kind", F.lit(names[k]))
        found = one if found is None else found.unionByName(one)
    return found


def global_distance(pointer: DataFrame, first: DataFrame, second: DataFrame, most: int | None = None) -> DataFrame:
    """(distance, path) between two sets of senses (synset), by rings of neighbours around the second until one of the first is met (GR-06).

    The path names the senses from the second set and the kind of each step; of equally short ones the least is given. Beyond most rings, and where
    nothing meets, there is no row.
    """
    near, target = settle(surroundings(pointer)), settle(first.select("synset").distinct())
    ring = settle(second.select("synset", F.col("synset").cast("string").alias("path")).distinct())
    seen, depth = ring.select("synset"), 0
    while not ring.isEmpty() and (most is None or depth <= most):
        met = ring.join(target, "synset", "left_semi")
        if not met.isEmpty():
            return met.agg(F.min("path").alias("path")).select(F.lit(depth).alias("distance"), "path")
        depth += 1
        step = ring.join(near, ring["synset"] == near["src"]).select(F.col("dst").alias("synset"), F.concat("path", F.lit(" : "), F.col("dst").cast("string"), F.lit("|"), "kind").alias("path"))
        ring = settle(step.join(seen, "synset", "left_anti").groupBy("synset").agg(F.min("path").alias("path")))
        seen = settle(seen.union(ring.select("synset")).distinct())
    return ring.limit(0).select(F.lit(0).alias("distance"), "path")


def are(pointer: DataFrame, kind: str, pairs: DataFrame) -> DataFrame:
    """(a, b, is_so): whether a is a neighbour of b of a kind, as broader (@) or narrower (~) (GR-07)."""
    near = pointed(pointer, kind).select(F.col("dst").alias("a"), F.col("src").alias("b"), F.lit(True).alias("is_so"))
    return pairs.join(near, ["a", "b"], "left").select("a", "b", F.coalesce("is_so", F.lit(False)).alias("is_so"))


def union(sets: DataFrame) -> DataFrame:
    """(synset): the senses of any of the sets (set, synset) (SO-04)."""
    return sets.select("synset").distinct()


def intersection(sets: DataFrame) -> DataFrame:
    """(synset): the senses that all sets (set, synset) have, by counting the sets of each (SO-04)."""
    n = sets.select("set").distinct().count()
    return sets.select("set", "synset").distinct().groupBy("synset").count().filter(F.col("count") == n).select("synset")


def inverted(pairs: DataFrame, key: str, value: str) -> DataFrame:
    """(value, key): a map from values to keys; of keys with one value the greatest holds (SO-05)."""
    return pairs.groupBy(value).agg(F.max(key).alias(key))
