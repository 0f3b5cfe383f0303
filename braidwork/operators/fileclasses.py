"""Classes of files from their headers and names: prefix groups, siblings, functions, bridges, assignment.

Headers and file names are metadata. Steps whose order matters run on the driver behind a check of their number; the rest
are plans over (file, header) rows.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import bounded_rows, materialize
from .resolution import components

#: Headers of a prefix group, suffix overlap of siblings, header overlap and score by which files group.
GROUP, SIBLING, CROSS_FILE, SCORE = 3, 0.8, 0.3, 0.5
#: Files whose metadata the driver may hold.
MAX_FILES = 20_000
#: Marks words among files; sorts after every name.
WORD = "\uffffword "


def prefix_groups(headers: DataFrame, least: int = GROUP, separator: str = "_") -> DataFrame:
    """(prefix, header, suffix): headers claimed by their longest prefix that ``least`` still free headers share.

    Prefixes of one header are nested, so the longest ones of all headers can be settled together, length by length.
    """
    h = headers.select("header").where("header is not null").distinct().withColumn("parts", F.split("header", separator))
    longest = h.agg(F.coalesce(F.max(F.size("parts")), F.lit(0))).first()[0]
    free, claimed = h, None
    for n in range(longest - 1, 0, -1):
        at = free.where(F.size("parts") > n).select("header", F.array_join(F.slice("parts", 1, n), separator).alias("prefix"))
        good = at.groupBy("prefix").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= least).select("prefix")
        won = materialize(at.join(good, "prefix", "left_semi"), "claimed-headers")
        claimed = won if claimed is None else claimed.unionByName(won)
        free = materialize(free.join(won.select("header"), "header", "left_anti"), "free-headers")
    if claimed is None:
        claimed = h.select("header", F.lit("").alias("prefix")).limit(0)
    return claimed.select("prefix", "header", F.substr("header", F.length("prefix") + 2).alias("suffix"))


def ungrouped(headers: DataFrame, groups: DataFrame) -> DataFrame:
    return headers.select("header").distinct().join(groups.select("header"), "header", "left_anti")


def siblings(groups: DataFrame, least: float = SIBLING) -> DataFrame:
    """(common_prefix, prefix): groups whose suffixes overlap, gathered around the first free one in order of size and name."""
    found: dict[str, set[str]] = defaultdict(set)
    for r in bounded_rows(groups.select("prefix", "suffix"), MAX_FILES, "header groups"):
        found[r["prefix"]].add(r["suffix"])
    order, used, out = sorted(found, key=lambda p: (-len(p), p)), set(), []
    for i, a in enumerate(order):
        if a in used:
            continue
        members = [a, *(b for b in order[i + 1 :] if b not in used and len(found[a] & found[b]) / len(found[a] | found[b]) >= least)]
        if len(members) > 1:
            used.update(members)
            common = members[0]
            while not all(m.startswith(common) for m in members):
                common = common[:-1]
            out += [(common.rstrip("_"), m) for m in members]
    return groups.sparkSession.createDataFrame(out, "common_prefix string, prefix string")


def header_overlap(headers: DataFrame) -> DataFrame:
    """(a, b, jaccard) of files (file, header) that share a header, a < b. Files without common headers do not arise."""
    h = headers.select("file", "header").distinct()
    sizes = h.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    both = h.select(F.col("file").alias("a"), "header").join(h.select(F.col("file").alias("b"), "header"), "header").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("k"))
    both = both.join(sizes.select(F.col("file").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("file").alias("b"), F.col("n").alias("nb")), "b")
    return both.select("a", "b", (F.col("k") / (F.col("na") + F.col("nb") - F.col("k"))).alias("jaccard"))


def cross_file_classes(classes: DataFrame, least: float = CROSS_FILE) -> DataFrame:
    """(parent, class, header, shared) of classes (class, prefix, header) merged over files.

    Classes merge with the first free one, in order of name, that has the same prefix or a header overlap above ``least``.
    shared headers are those of all members; a class alone is its own parent and shares nothing.
    """
    heads, prefix = defaultdict(set), {}
    for r in bounded_rows(classes.select("class", "prefix", "header"), MAX_FILES * 10, "class headers"):
        heads[r["class"]].add(r["header"])
        prefix[r["class"]] = r["prefix"]
    used, out = set(), []
    for i, a in enumerate(order := sorted(heads)):
        if a in used:
            continue
        group = [a, *(b for b in order[i + 1 :] if b not in used and (prefix[a] and prefix[a] == prefix[b] or len(heads[a] & heads[b]) / len(heads[a] | heads[b]) > least))]
        shared = set.intersection(*(heads[g] for g in group)) if len(group) > 1 else set()
        if len(group) > 1:
            used.update(group)
        out += [(a, g, h, h in shared) for g in group for h in sorted(heads[g])]
    return classes.sparkSession.createDataFrame(out, "parent string, class string, header string, shared boolean")


class _Sets:
    def __init__(self, keys):
        self.up = {k: k for k in keys}

    def root(self, k):
        while self.up[k] != k:
            self.up[k] = self.up[self.up[k]]
            k = self.up[k]
        return k

    def join(self, a, b) -> None:
        a, b = sorted((self.root(a), self.root(b)))
        self.up[b] = a

    def groups(self) -> list[set]:
        out = defaultdict(set)
        for k in self.up:
            out[self.root(k)].add(k)
        return [out[k] for k in sorted(out)]


def _plain(token: str) -> str:
    t = token.lower()
    return t[:-1] if len(t) > 3 and t.endswith("s") else t


def file_clusters(tokens: dict[str, set[str]]) -> list[set[str]]:
    """Files that share two words, with single files joined over words of three or more files or of one cluster's identity."""
    files, of = sorted(tokens), defaultdict(set)
    for f in files:
        for t in tokens[f]:
            of[t].add(f)
    sets, holder = _Sets(files), {}
    for f in files:  # files with the same two words meet at the first of them
        for pair in combinations(sorted(tokens[f]), 2):
            sets.join(holder.setdefault(pair, f), f)

    first = {f: sets.root(f) for f in files}
    large = {r for r, n in Counter(first.values()).items() if n > 1}
    for t in sorted(of):
        if len(of[t]) >= 3:
            roots = {first[f] for f in of[t]}
            if len(roots) > 1 and len(roots & large) <= 1:
                target = sorted(roots & large or roots)[0]
                for r in sorted(roots - {target} - (roots & large)):
                    sets.join(target, r)
    groups = sets.groups()
    if any(len(g) > 1 for g in groups):
        changed = True
        while changed:  # each round a single file joins the first group one of whose words of two files it has
            changed, known = False, {}
            for g in sets.groups():
                if len(g) > 1:
                    for t, n in Counter(t for f in g for t in tokens[f]).items():
                        if n >= 2:
                            known.setdefault(t, min(g))
            for g in sets.groups():
                targets = sorted(known[t] for f in g for t in tokens[f] if t in known) if len(g) == 1 else []
                if targets:
                    sets.join(targets[0], min(g))
                    changed = True
        single = {f for g in sets.groups() if len(g) == 1 for f in g}
        for t in sorted(of):
            if len(of[t]) >= 2 and of[t] <= single:
                a, *rest = sorted(of[t])
                for b in rest:
                    sets.join(a, b)
    return sets.groups()


def token_roles(file_tokens: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((token, role), (file, cluster)) of words in file names (file, token): lob, function or modifier.

    A word of two clusters is a function, one of several files of one cluster their line of business; a word of one file is
    that file's function if it is the only one beside its line of business, else a modifier. Without any cluster of
    several files, words of two or more files are functions.
    """
    tokens: dict[str, set[str]] = defaultdict(set)
    for r in bounded_rows(file_tokens.select("file", "token").where("file is not null and token is not null"), MAX_FILES * 10, "file words"):
        tokens[r["file"]].add(_plain(r["token"]))
    clusters = file_clusters(dict(tokens))
    number = {f: i for i, g in enumerate(clusters) for f in g}
    files_of = defaultdict(set)
    for f, ts in tokens.items():
        for t in ts:
            files_of[t].add(f)
    several = any(len(g) > 1 for g in clusters)
    role = {}
    for t, fs in files_of.items():
        spread = {number[f] for f in fs}
        if not several:
            role[t] = "function" if len(fs) > 1 else "modifier"
        else:
            role[t] = "function" if len(spread) > 1 else "lob" if len(fs) > 1 else "modifier"
    if several:
        for f, ts in tokens.items():
            own = [t for t in ts if role[t] != "lob"]
            if len(own) == 1 and role[own[0]] == "modifier":
                role[own[0]] = "function"
    spark = file_tokens.sparkSession
    return spark.createDataFrame(sorted(role.items()), "token string, role string"), spark.createDataFrame(sorted((f, c) for f, c in number.items()), "file string, cluster int")


def function_groups(headers: DataFrame, file_tokens: DataFrame, least: float = SCORE) -> DataFrame:
    """(group, file): files of different lines of business with the same function, by the name of the first file of each group.

    Half a point for a common function word, 0.3 for a common header prefix of two headers, 0.2 for a header overlap above
    0.1; files of one line of business never group directly. Single files count as lines of their own. A file without a
    partner is a group. Files meet by equality on words, prefixes and headers, never all with all.
    """
    roles, clusters = token_roles(file_tokens)
    line = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    line = clusters.join(line, "cluster").select("file", F.when(F.col("n") > 1, F.concat(F.lit("line "), F.col("cluster"))).otherwise(F.concat(F.lit("file "), F.col("file"))).alias("line"))
    t = F.lower("token")
    words = file_tokens.where("file is not null and token is not null").select("file", F.when((F.length(t) > 3) & t.endswith("s"), F.substr(t, F.lit(1), F.length(t) - 1)).otherwise(t).alias("token")).distinct()
    functions = roles.where("role = 'function'").select("token")
    words = words.join(functions, "token", "left_semi") if not functions.isEmpty() else words
    heads = headers.where("file is not null and header is not null").select("file", "header").distinct()
    files = words.select("file").union(file_tokens.select("file")).union(heads.select("file")).where("file is not null").distinct()
    lines = files.join(line, "file", "left").withColumn("line", F.coalesce("line", F.concat(F.lit("file "), F.col("file"))))
    prefix = heads.where(F.col("header").rlike("^[^_]+_")).withColumn("prefix", F.split("header", "_")[0]).groupBy("file", "prefix").agg(F.count(F.lit(1)).alias("k")).where("k >= 2").select("file", "prefix")

    def meet(df: DataFrame, on: str) -> DataFrame:
        return df.withColumnRenamed("file", "a").join(df.withColumnRenamed("file", "b"), on).where("a < b").select("a", "b").distinct()

    if least <= 0.5:  # a common function word is enough: the files of a word meet at the word if they are of several lines
        several = words.join(lines, "file").groupBy("token").agg(F.count_distinct("line").alias("n")).where("n > 1").select("token")
        links = words.join(several, "token", "left_semi").select(F.col("file").alias("a"), F.concat(F.lit(WORD), "token").alias("b"))
    else:
        links = None
    scored = meet(words, "token").withColumn("s", F.lit(0.5)).unionByName(meet(prefix, "prefix").withColumn("s", F.lit(0.3))) if links is None else meet(prefix, "prefix").withColumn("s", F.lit(0.3))
    scored = scored.unionByName(header_overlap(heads).where("jaccard > 0.1").select("a", "b", F.lit(0.2).alias("s"))).groupBy("a", "b").agg(F.sum("s").alias("s")).where(F.round("s", 6) >= least)
    la, lb = lines.select(F.col("file").alias("a"), F.col("line").alias("la")), lines.select(F.col("file").alias("b"), F.col("line").alias("lb"))
    scored = scored.join(la, "a").join(lb, "b").where("la <> lb").select("a", "b")
    found = components(scored if links is None else links.unionByName(scored)).where(~F.col("id").startswith(WORD))
    first = found.groupBy("component").agg(F.min("id").alias("group"))
    return files.join(found.join(first, "component").select(F.col("id").alias("file"), "group"), "file", "left").select(F.coalesce("group", "file").alias("group"), "file")


def functional_classes(headers: DataFrame, groups: DataFrame) -> DataFrame:
    """(group, file, header, shared): shared headers are in all files of the group and belong to its parent class."""
    rows = headers.select("file", "header").distinct().join(groups, "file")
    n = groups.groupBy("group").agg(F.count(F.lit(1)).alias("n"))
    k = rows.groupBy("group", "header").agg(F.count_distinct("file").alias("k")).join(n, "group").select("group", "header", (F.col("k") == F.col("n")).alias("shared"))
    return rows.join(k, ["group", "header"]).select("group", "file", "header", "shared")


def bridge_columns(class_headers: DataFrame) -> DataFrame:
    """(source_class, target_class, bridge_column) for each header (class, header) of two classes, names in order."""
    h = class_headers.select("class", "header").distinct()
    return h.select(F.col("class").alias("source_class"), "header").join(h.select(F.col("class").alias("target_class"), "header"), "header").where("source_class < target_class").select("source_class", "target_class", F.col("header").alias("bridge_column"))


def file_class_map(classes: DataFrame) -> DataFrame:
    """(file, class) of (class, level, file): the deepest class of a file by base name, ties to the last name."""
    name = F.element_at(F.split("file", "/"), -1)
    return classes.groupBy(name.alias("file")).agg(F.max(F.struct("level", "class"))["class"].alias("class"))


def assign_entities(entity_files: DataFrame, file_class: DataFrame) -> DataFrame:
    """(id, class) of (id, file): the class of most of an entity's files, ties to the first name; else Unclassified."""
    rows = entity_files.select("id", F.element_at(F.split("file", "/"), -1).alias("file")).join(file_class, "file", "left")
    votes = rows.groupBy("id", "class").agg(F.count(F.lit(1)).alias("v"))
    best = votes.groupBy("id").agg(F.min(F.when(F.col("class").isNotNull(), F.struct((-F.col("v")).alias("v"), "class")))["class"].alias("class"))
    return best.select("id", F.coalesce("class", F.lit("Unclassified")).alias("class"))
