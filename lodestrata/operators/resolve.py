"""Names resolved to entities by an ordered list of strategies, and inheritance.

Each strategy is a join that yields candidates with its priority; the winner of a call is the least
by priority and tie-break.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.operators.graph import extends_edges, nodes
from lodestrata.session import cut

#: Names that a language brings with it, and where they live.
PYTHON_BUILTINS = (
    "print len range int str float bool list dict set tuple open type isinstance hasattr getattr setattr delattr enumerate zip map filter sorted reversed any all sum min max abs round input "
    "super classmethod staticmethod property callable iter next repr hash id dir vars globals locals compile eval exec format Exception ValueError TypeError KeyError IndexError AttributeError "
    "RuntimeError StopIteration NotImplementedError AssertionError ImportError OSError IOError FileNotFoundError"
).split()
SCRIPT_TYPES = (
    "Array Object String Number Date RegExp Function Map Set WeakMap WeakSet Promise Error Boolean Symbol BigInt ArrayBuffer DataView Int8Array Uint8Array Float32Array Float64Array Proxy Reflect Intl"
).split()
SCRIPT_FUNCTIONS = (
    "Object.create Object.keys Object.values Object.entries Object.assign Object.freeze Object.seal Object.defineProperty Object.getOwnPropertyNames Object.getPrototypeOf Array.from Array.isArray Array.of "
    "parseInt parseFloat isNaN isFinite encodeURI decodeURI encodeURIComponent decodeURIComponent console.log console.error console.warn console.info console.debug console.trace JSON.parse JSON.stringify "
    "Math.random Math.floor Math.ceil Math.round Math.abs Math.max Math.min Math.pow Math.sqrt Date.now Date.parse Promise.resolve Promise.reject Promise.all Promise.race Promise.allSettled "
    "Reflect.get Reflect.set Reflect.has Reflect.apply setTimeout setInterval clearTimeout clearInterval fetch require"
).split()
SCRIPT_SUFFIXES = ("call", "apply", "bind")
SCRIPT_FILES = r"\.(?:[cm]?js|jsx|[cm]?ts|tsx)$"


def module_qn(project: Column, path: Column) -> Column:
    """Qualified name of a path's module: project, then the parts below it without extension; a trailing __init__ is dropped."""
    below = F.regexp_replace(path, r"^/srv/repos/[^/]+/", "")
    dotted = F.regexp_replace(F.regexp_replace(below, r"\.[^./]*$", ""), "/", ".")
    return F.concat_ws(".", project, F.regexp_replace(dotted, r"\.?__init__$", ""))


def module_distance(a: Column, b: Column) -> Column:
    """Parts of both dotted names beyond their common beginning, 2 less if b lies below a's module."""
    left, right = F.split(a, r"\."), F.split(b, r"\.")
    same = F.transform(F.arrays_zip(left.alias("l"), right.alias("r")), lambda x: x["l"] == x["r"])
    common = F.size(F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.size(left), F.size(right))), lambda n: F.forall(F.slice(same, F.lit(1), n), lambda y: F.coalesce(y, F.lit(False)))), lambda y: y))
    return F.size(left) + F.size(right) - 2 * common - F.when(F.startswith(b, F.concat(a, F.lit("."))), 2).otherwise(0)


def script_module(module: Column, source: Column) -> Column:
    """Qualified name of the module that a script's module names as `source`: relative to its own folder, or with dots for slashes."""
    parts = F.filter(F.split(source, "/"), lambda part: ~part.isin("", "."))
    folder = F.slice(F.split(module, r"\."), F.lit(1), F.greatest(F.size(F.split(module, r"\.")) - 1, F.lit(0)))
    walked = F.aggregate(parts, folder, lambda at, part: F.when(part == "..", F.slice(at, F.lit(1), F.greatest(F.size(at) - 1, F.lit(0)))).otherwise(F.array_append(at, part)))
    return F.when(F.startswith(source, F.lit(".")), F.array_join(walked, ".")).otherwise(F.replace(source, F.lit("/"), F.lit(".")))


def python_module(project: Column, module: Column, source: Column) -> Column:
    """Qualified name of the module that a Python module names as `source`; leading dots climb from its own name."""
    dots = F.length(F.regexp_extract(source, r"^(\.*)", 1))
    below = F.slice(F.split(module, r"\."), F.lit(2), F.greatest(F.size(F.split(module, r"\.")) - 1 - dots, F.lit(0)))
    rest = F.filter(F.split(F.substr(source, dots + 1), r"\."), lambda part: part != "")
    return F.when(dots > 0, F.array_join(F.concat(F.array(project), below, rest), ".")).otherwise(source)


def import_map(imports: DataFrame) -> DataFrame:
    """(project, file_path, local, target): what a name of a file stands for by its imports; of several the one on the last line.

    A Python import without alias brings the first part of its name, a star brings all of a module,
    under `*` and the module's name. A script's star brings the module under its alias.
    """
    project, name, source = F.col("project_name"), F.col("name"), F.expr("nullif(source, '')")
    alias = F.expr("nullif(alias, '')")
    module = module_qn(project, F.col("file_path"))
    script = F.col("file_path").rlike(SCRIPT_FILES)
    base = F.when(script, script_module(module, source)).otherwise(python_module(project, module, source))
    local = (
        F.when(source.isNull() & ~script, F.coalesce(alias, F.substring_index(name, ".", 1)))
        .when((name == "*") & ~script, F.concat(F.lit("*"), base)).otherwise(F.coalesce(alias, name))
    )
    target = F.when(source.isNull(), name).when(name == "*", base).otherwise(F.concat_ws(".", base, name))
    rows = imports.select(project.alias("project"), "file_path", local.alias("local"), target.alias("target"), "line_number")
    return rows.where("local is not null").groupBy("project", "file_path", "local").agg(F.max(F.struct("line_number", "target")).getField("target").alias("target"))


def resolve_name(names: DataFrame, imports: DataFrame, entities: DataFrame) -> DataFrame:
    """(project, file_path, name, target) of the names (project, file_path, name) of files: as imported, else an entity that a star brings; else null."""
    mapped = import_map(imports)
    direct = names.join(mapped.withColumnRenamed("local", "name"), ["project", "file_path", "name"]).select("project", "file_path", "name", F.struct(F.lit(1).alias("place"), "target").alias("t"))
    stars = mapped.where(F.startswith("local", F.lit("*"))).select("project", "file_path", F.col("target").alias("base"))
    known = nodes(entities).select("project", F.col("qn").alias("target")).distinct()
    brought = names.join(stars, ["project", "file_path"]).withColumn("target", F.concat_ws(".", "base", "name")).join(known, ["project", "target"], "left_semi")
    found = direct.unionByName(brought.select("project", "file_path", "name", F.struct(F.lit(2).alias("place"), "target").alias("t")))
    best = found.groupBy("project", "file_path", "name").agg(F.min("t").alias("t"))
    return names.distinct().join(best, ["project", "file_path", "name"], "left").select("project", "file_path", "name", "t.target")


def nearest_named(asked: DataFrame, known: DataFrame) -> DataFrame:
    """(project, module, tail, far, target) of the entity named `tail` that is nearest to a module; ties by name.

    Of all entities of a name that lie below a prefix only the one with the shortest name counts,
    so a name that everything has is one row a prefix, and a module asks its own prefixes.
    """
    parts = F.split("qn", r"\.")
    upto = lambda whole, n: F.array_join(F.slice(whole, F.lit(1), n), ".")
    spread = known.where("tail is not null").select("project", "tail", "qn", F.size(parts).alias("size"), parts.alias("parts"), F.explode(F.sequence(F.lit(1), F.size(parts))).alias("n"))
    best = spread.groupBy("project", "tail", upto(F.col("parts"), F.col("n")).alias("prefix"), (F.col("n") < F.col("size")).alias("inside")).agg(F.min(F.struct("size", "qn")).alias("s"))
    own = F.split("module", r"\.")
    asks = asked.select("project", "module", "tail").distinct().withColumns({"own": own, "n": F.explode(F.sequence(F.lit(1), F.size(own)))})
    asks = asks.withColumn("prefix", upto(F.col("own"), F.col("n")))
    bonus = F.when(F.col("inside") & (F.col("n") == F.size("own")), 2).otherwise(0)
    joined = asks.join(best, ["project", "tail", "prefix"]).withColumn("far", F.size("own") + F.col("s.size") - 2 * F.col("n") - bonus)
    return joined.groupBy("project", "module", "tail").agg(F.min(F.struct("far", F.col("s.qn").alias("target"))).alias("b")).select("project", "module", "tail", "b.far", "b.target")


def annotated_parameters(entities: DataFrame) -> DataFrame:
    """(project, caller, variable, type) of parameters whose annotation is the name of one type."""
    pairs = F.regexp_extract_all("signature", F.lit(r"([A-Za-z_]\w*\??\s*:\s*[A-Z]\w*)\s*[,)=]"), F.lit(1))
    rows = nodes(entities).where("signature is not null").select("project", F.col("qn").alias("caller"), F.explode(pairs).alias("pair"))
    return rows.select("project", "caller", F.regexp_extract("pair", r"^(\w+)", 1).alias("variable"), F.regexp_extract("pair", r"(\w+)$", 1).alias("type")).distinct()


def _types_to_classes(types: DataFrame, mapped: DataFrame, known: DataFrame) -> DataFrame:
    """Adds `class` to rows (project, file_path, module, type): itself if dotted, as imported, of the module, else the first class of the name."""
    classes = known.where("label = 'Class'")
    first = classes.groupBy("project", F.col("name").alias("type")).agg(F.min("qn").alias("by_name"))
    own = classes.select("project", F.col("qn").alias("own")).distinct()
    rows = types.join(mapped.select("project", "file_path", F.col("local").alias("type"), F.col("target").alias("imported")), ["project", "file_path", "type"], "left")
    rows = rows.withColumn("own", F.concat_ws(".", "module", "type")).join(own.withColumn("there", F.lit(True)), ["project", "own"], "left").join(first, ["project", "type"], "left")
    found = F.when(F.contains("type", F.lit(".")), F.col("type")).otherwise(F.coalesce("imported", F.when(F.col("there"), F.col("own")), "by_name"))
    return rows.withColumn("class", found).drop("imported", "own", "there", "by_name").where("class is not null")


def inherited_targets(entities: DataFrame) -> DataFrame:
    """(project, class, method, inherited): the nearest ancestor's method of each name, the class's own left out."""
    methods = nodes(entities).where("label = 'Method'").select("project", F.regexp_extract("qn", r"(?s)^(.*)\.", 1).alias("ancestor"), F.substring_index("qn", ".", -1).alias("method"), "qn").distinct()
    joined = ancestors(entities).where("depth > 0").join(methods, ["project", "ancestor"])
    return joined.groupBy("project", "class", "method").agg(F.min(F.struct("depth", "ord", "ancestor", "qn")).getField("qn").alias("inherited"))


def resolve_calls(entities: DataFrame, imports: DataFrame, local_types: DataFrame | None = None) -> DataFrame:
    """(project, caller, call, strategy, target) of each distinct call text of an entity.

    In this order: `qualified`, the text is a qualified name of the project; `iife`, a function
    called where it stands; `super`, the nearest ancestor's method, and nothing else if there is
    none; `chain`, the method of what a call in the text makes, and nothing else; `import`, what the
    text or its first part is imported as, the method of the type of its first part, an entity that a
    star brings, whichever of these is an entity; `module`, an entity of the caller's module with the
    text's first part as name; `builtin`, what the language brings; `simple`, the nearest entity of the
    project with the last part as name; else `none`. `local_types` (project, caller, variable, type)
    says what type the names in a caller have.
    """
    known = nodes(entities).select("project", "qn", "name", "label", "file_path")
    exists = known.select("project", F.col("qn").alias("target")).distinct()
    owner = F.when(F.col("type") == "method", F.regexp_extract("qualified_name", r"(?s)^(.*)\.", 1))
    calls = entities.select(
        F.col("project_name").alias("project"), F.col("qualified_name").alias("caller"), "file_path", owner.alias("class"), F.explode("calls").alias("call")
    ).where("call is not null and call != ''").distinct()
    call = F.col("call")
    on_super = (call == "super") | F.startswith(call, F.lit("super.")) | F.startswith(call, F.lit("super()"))
    chained = F.contains(call, F.lit(").")) & call.contains("(")
    calls = calls.withColumns(
        {
            "module": module_qn(F.col("project"), F.col("file_path")), "script": F.col("file_path").rlike(SCRIPT_FILES),
            "form": F.when(on_super, "super").when(chained, "chain").otherwise("plain"),
            "head": F.substring_index("call", ".", 1), "rest": F.substring_index(F.when(call.contains("."), F.substr(call, F.instr(call, ".") + 1)), "(", 1),
            "tail": F.substring_index(F.substring_index("call", ".", -1), "(", 1),
        }
    )
    calls = cut(calls)
    keys = ["project", "caller", "call"]
    plain = calls.where("form = 'plain'")
    mapped = cut(import_map(imports))
    above = cut(inherited_targets(entities))

    def candidate(rows: DataFrame, place: int, strategy: str) -> DataFrame:
        return rows.select(*keys, F.struct(F.lit(place).alias("place"), F.lit(strategy).alias("strategy"), "target").alias("c"))

    def methods_of(rows: DataFrame, method: Column) -> DataFrame:
        """Rows with a class, with the method of the class or else its nearest ancestor as target."""
        rows = rows.withColumns({"method": method, "own": F.concat_ws(".", "class", method)})
        both = rows.join(exists.select("project", F.col("target").alias("own"), F.lit(True).alias("there")), ["project", "own"], "left").join(above, ["project", "class", "method"], "left")
        return both.withColumn("target", F.when(F.col("there"), F.col("own")).otherwise(F.col("inherited"))).where("target is not null")

    existing = lambda rows, target: rows.withColumn("target", target).join(exists, ["project", "target"], "left_semi")
    found = [candidate(existing(calls, call), 1, "qualified")]
    found.append(candidate(existing(calls.where(F.col("script") & call.rlike("^iife_(?:func|arrow)_")), F.concat_ws(".", "module", "call")), 2, "iife"))
    above_name = F.when(call.isin("super", "super()"), "__init__").otherwise(F.col("rest"))
    supers = calls.where("form = 'super' and class is not null").withColumn("method", above_name).join(above, ["project", "class", "method"]).withColumnRenamed("inherited", "target")
    found.append(candidate(supers, 3, "super"))
    local = mapped.select("project", "file_path", "local", F.col("target").alias("imported"))
    typed = None if local_types is None else local_types.select("project", "caller", F.col("variable").alias("head"), "type")
    # what a call makes: an object of the class that is called, or of the type a name has
    made = calls.where("form = 'chain'").withColumns({"method": F.regexp_extract("call", r"\.([^.()]+)$", 1), "type": F.regexp_extract("call", r"^([\w.]+)\([^()]*\)\.[^.()]+$", 1)}).where("method != '' and type != ''")
    found.append(candidate(methods_of(_types_to_classes(made.drop("class"), mapped, known), F.col("method")), 4, "chain"))
    found.append(candidate(existing(plain.join(local.withColumnRenamed("local", "call"), ["project", "file_path", "call"]), F.col("imported")), 5, "import"))
    if typed is not None:
        receivers = plain.where("rest is not null").drop("class").join(typed, ["project", "caller", "head"])
        found.append(candidate(methods_of(_types_to_classes(receivers, mapped, known), F.col("rest")), 6, "import"))
    parts = plain.where("rest is not null").join(local.withColumnRenamed("local", "head"), ["project", "file_path", "head"])
    found.append(candidate(existing(parts, F.concat_ws(".", "imported", "rest")), 7, "import"))
    stars = local.where(F.startswith("local", F.lit("*"))).drop("local")
    found.append(candidate(existing(plain.join(stars, ["project", "file_path"]), F.concat_ws(".", "imported", "call")), 8, "import"))
    found.append(candidate(existing(plain, F.concat_ws(".", "module", F.substring_index("head", "(", 1))), 9, "module"))
    bare = F.substring_index("call", "(", 1)
    suffix = F.regexp_extract("call", rf"\.({'|'.join(SCRIPT_SUFFIXES)})$", 1)
    built = (
        F.when(~F.col("script"), F.when(bare.isin(*PYTHON_BUILTINS), F.concat(F.lit("builtins."), bare)))
        .when(call.isin(*SCRIPT_FUNCTIONS), F.concat(F.lit("builtin."), call)).when(bare.isin(*SCRIPT_TYPES), F.concat(F.lit("builtin."), bare))
        .when(suffix != "", F.concat(F.lit("builtin.Function.prototype."), suffix))
    )
    found.append(candidate(plain.withColumn("target", built).where("target is not null"), 10, "builtin"))
    near = nearest_named(plain, known.select("project", F.substring_index("qn", ".", -1).alias("tail"), "qn"))
    found.append(candidate(plain.join(near, ["project", "module", "tail"]), 11, "simple"))
    found.append(candidate(calls.withColumn("target", F.lit(None).cast("string")), 12, "none"))
    every = reduce(DataFrame.unionByName, found)
    return every.groupBy(*keys).agg(F.min("c").alias("c")).select(*keys, "c.strategy", "c.target")


def least_links(extends: DataFrame) -> DataFrame:
    """(project, origin, reached, depth, ord): all pairs that any number of links joins, with the least depth and the least ord of a first link at it.

    A round doubles the depth: pairs just as far apart as was looked for go on by all pairs found,
    so a chain of n links takes log n rounds, and loops end as a round finds only new pairs.
    """
    keys = ["project", "origin", "reached"]
    found = cut(extends.where("src != dst").select("project", F.col("src").alias("origin"), F.col("dst").alias("reached"), F.lit(1).alias("depth"), "ord"), "project", "origin")
    hops, before, count = 1, 0, found.count()
    while before < count:
        far = found.where(F.col("depth") == hops).select("project", "origin", F.col("reached").alias("middle"), "ord")
        near = found.select("project", F.col("origin").alias("middle"), "reached", (F.col("depth") + hops).alias("depth"))
        new = far.join(near, ["project", "middle"]).where("origin != reached").join(found.select(*keys), keys, "left_anti")
        new = new.groupBy(*keys).agg(F.min(F.struct("depth", "ord")).alias("m")).select(*keys, "m.depth", "m.ord")
        found = cut(found.unionByName(new), "project", "origin")
        hops, before, count = 2 * hops, count, found.count()
    return found


def ancestors(entities: DataFrame) -> DataFrame:
    """(project, class, ancestor, depth, ord): the method resolution order, breadth first and of any depth; ord is the place of the first link, the class itself has depth 0."""
    own = nodes(entities).where(F.col("label").isin("Class", "Interface")).select("project", F.col("qn").alias("class"), F.col("qn").alias("ancestor"), F.lit(0).alias("depth"), F.lit(0).alias("ord"))
    return own.unionByName(least_links(extends_edges(entities)).select("project", F.col("origin").alias("class"), F.col("reached").alias("ancestor"), "depth", "ord"))


def _followed(a: DataFrame, b: DataFrame) -> DataFrame:
    """Ways (project, src, dst, n) of `a` that go on by one of `b`, counted."""
    joined = a.select("project", "src", F.col("dst").alias("middle"), F.col("n").alias("m")).join(b.select("project", F.col("src").alias("middle"), "dst", "n"), ["project", "middle"])
    return joined.groupBy("project", "src", "dst").agg(F.sum(F.col("m") * F.col("n")).alias("n"))


def _summed(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts).groupBy("project", "src", "dst").agg(F.sum("n").alias("n"))


def subclass_paths(entities: DataFrame) -> DataFrame:
    """(project, class, subclass, paths): descendants with the number of paths of any length, no link twice in a path; a diamond gives two.

    Links of loops are walked one by one, as a path may not repeat them. All others lead from loop
    to loop without return, so their paths are products of counts, and a round doubles their length.
    """
    edges = cut(extends_edges(entities).select("project", "src", "dst", "ord"), "project", "src")
    back = least_links(edges).select("project", F.col("reached").alias("src"), F.col("origin").alias("dst")).unionByName(edges.where("src = dst").select("project", "src", "dst"))
    keys = ["project", "src", "dst"]
    looped = cut(edges.join(back, keys, "left_semi").select(*keys), "project", "src")
    plain = edges.join(back, keys, "left_anti").select(*keys, F.lit(1).cast("long").alias("n"))
    step = looped.select("project", F.col("src").alias("at"), F.col("dst").alias("next"))
    here = cut(looped.select(*keys, F.array(F.struct("src", "dst")).alias("used")), "project", "dst")
    around = here.groupBy(*keys).agg(F.count("*").alias("n"))
    while not here.isEmpty():
        grown = here.withColumnRenamed("dst", "at").join(step, ["project", "at"]).withColumn("link", F.struct(F.col("at").alias("src"), F.col("next").alias("dst")))
        grown = grown.where(~F.array_contains("used", F.col("link"))).select("project", "src", F.col("next").alias("dst"), F.array_append("used", F.col("link")).alias("used"))
        here = cut(grown, "project", "dst")
        around = cut(_summed(around, here.groupBy(*keys).agg(F.count("*").alias("n"))), "project", "src")
    # single: paths of `power` plain links with what lies around behind each; total: of 1 to `power`
    single = total = cut(_summed(plain, _followed(plain, around)), "project", "src")
    while not single.isEmpty():
        total = cut(_summed(total, _followed(single, total)), "project", "src")
        single = cut(_followed(single, single), "project", "src")
    ways = _summed(around, total, _followed(around, total))
    return ways.select("project", F.col("dst").alias("class"), F.col("src").alias("subclass"), F.col("n").alias("paths"))


def inherited_methods(entities: DataFrame) -> DataFrame:
    """(project, class, method, defined_in): each method name a class has, from the nearest class in its resolution order."""
    methods = nodes(entities).where("label = 'Method'").select("project", F.regexp_extract("qn", r"(?s)^(.*)\.", 1).alias("ancestor"), F.col("name").alias("method")).distinct()
    joined = ancestors(entities).join(methods, ["project", "ancestor"])
    return joined.groupBy("project", "class", "method").agg(F.min(F.struct("depth", "ord", "ancestor")).getField("ancestor").alias("defined_in"))


#: Scores of a parameter's name that is a class's, that ends with one or is the end of one, and of one that contains a class's, by its part; and what must be exceeded.
SAME_NAME, SAME_END, CONTAINED, LEAST_SCORE = 100, 90, 80, 50


def parameters(entities: DataFrame) -> DataFrame:
    """(project, function, module, file_path, parameter) of the parameters in the signatures of functions and methods."""
    known = nodes(entities).where("signature is not null and label in ('Function', 'Method')")
    inside = F.regexp_extract("signature", r"(?s)\((.*)\)", 1)
    flat = inside
    for _ in range(3):
        flat = F.regexp_replace(flat, r"\([^()]*\)|\[[^\[\]]*\]|\{[^{}]*\}|<[^<>]*>", "")
    names = F.array_distinct(F.regexp_extract_all(flat, F.lit(r"(?:^|,)\s*\*{0,2}(?:\.\.\.)?([A-Za-z_]\w*)"), F.lit(1)))
    return known.select("project", F.col("qn").alias("function"), module_qn(F.col("project"), F.col("file_path")).alias("module"), "file_path", F.explode(names).alias("parameter"))


def parameter_types(entities: DataFrame, imports: DataFrame) -> DataFrame:
    """(project, function, parameter, class, score): the class of the module, or imported by its file, whose name a parameter's name speaks of.

    Letters count in any case: 100 for the same name, 90 where one is the end of the other, 80 by
    the part of the parameter's name that is the class's; the best counts if it is over 50, ties
    by the class's name, else class is null and the score 0.

    Of the classes of a module one remains for each ending of their names, and a parameter's name
    brings its own endings and long parts, so the match is a join on equal keys.
    """
    known = nodes(entities)
    classes = known.where("label = 'Class' and name is not null and name != ''")
    own = classes.where(F.col("qn") == F.concat_ws(".", module_qn(F.col("project"), F.col("file_path")), "name")).select("project", "file_path", "name")
    targets = classes.select("project", F.col("qn").alias("target"))
    brought = import_map(imports).join(targets, ["project", "target"], "left_semi").select("project", "file_path", F.col("local").alias("name"))
    available = own.unionByName(brought).distinct().withColumn("low", F.lower("name"))
    ending = lambda low: F.transform(F.sequence(F.lit(1), F.length(low)), lambda at: F.substr(low, at))
    keys = available.withColumn("key", F.explode(ending(F.col("low")))).groupBy("project", "file_path", "key").agg(
        F.max(F.when(F.col("key") == F.col("low"), 1).otherwise(0)).alias("whole"),
        F.min(F.when(F.col("key") == F.col("low"), F.col("name"))).alias("whole_name"), F.min("name").alias("end_name"),
    )
    asked = parameters(entities).withColumns({"low": F.lower("parameter"), "size": F.length("parameter")})
    parts = F.flatten(F.transform(F.sequence(F.lit(1), F.col("size")), lambda at: F.transform(F.sequence(F.lit(1), F.col("size") - at + 1), lambda n: F.substr(F.col("low"), at, n))))
    least = F.floor(F.lit(LEAST_SCORE) * F.col("size") / CONTAINED)
    wanted = asked.withColumn("key", F.explode(F.array_distinct(F.concat(ending(F.col("low")), F.filter(parts, lambda part: F.length(part) > least)))))
    joined = wanted.join(keys, ["project", "file_path", "key"])
    same = F.col("key") == F.col("low")
    inner = (F.lit(CONTAINED) * F.length("key") / F.col("size")).cast("int")
    score = F.when(same & (F.col("whole") == 1), SAME_NAME).when(same, SAME_END).when((F.col("whole") == 1) & F.endswith("low", "key"), SAME_END).when(F.col("whole") == 1, inner).otherwise(0)
    named = F.when(same & (F.col("whole") == 0), F.col("end_name")).otherwise(F.coalesce("whole_name", "end_name"))
    scored = joined.select("project", "function", "parameter", score.alias("score"), named.alias("class")).where(F.col("score") > LEAST_SCORE)
    best = scored.groupBy("project", "function", "parameter").agg(F.min(F.struct((-F.col("score")).alias("s"), "class")).alias("b"))
    every = asked.select("project", "function", "parameter").distinct()
    return every.join(best, ["project", "function", "parameter"], "left").select("project", "function", "parameter", F.col("b.class").alias("class"), F.coalesce(-F.col("b.s"), F.lit(0)).alias("score"))
