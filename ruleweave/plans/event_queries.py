"""Queries over events: detection rules, tactics, tokens, windows, generated samples and file scans, with their DuckDB SQL.

Events of every kind are made from the rules themselves: for each value that a rule
names there is one that the rule should find, and one with a part of it missing.
The driver's events are dealt to them, so that all rules run over the whole table.
"""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleweave.functions import detect
from ruleweave.functions import text as T
from ruleweave.operators import logs
from ruleweave.sources import generators, loaders

FIELDS = ["Image", "ParentImage", "CommandLine", "TargetFilename", "ImageLoaded", "PipeName", "QueryName", "TargetObject", "Details", "TargetImage", "GrantedAccess", "Signed", "SignatureStatus", "Initiated", "DestinationPort", "DestinationIp"]


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _made(tests: list, k: int) -> dict[str, str]:
    """Fields that pass the tests, by the k-th value of each."""
    parts: dict[str, list[str]] = {}
    out: dict[str, str] = {}
    for name, kind, values in tests:
        value = values[k % len(values)]
        if kind in ("any", "all"):
            out |= _made([value] if kind == "any" else values, k)
        elif kind == "is":
            out[name] = str(value)
        elif kind in ("has", "ends"):
            parts.setdefault(name, []).append(value)
        elif kind == "begins":
            parts.setdefault(name, []).insert(0, value)
        elif kind == "not is" and name not in out:
            out[name] = "other.exe" if "mage" in name else "x"
        elif kind == "longer":
            out[name] = "ab." * 30
        elif kind == "label longer":
            out[name] = "a" * 41 + ".org"
        elif kind in ("bits", "least"):
            out[name] = hex(value)
    for name, own in parts.items():
        out[name] = " ".join(own) if name == "CommandLine" else "".join(own)
    image, path = out.pop("Image", None), out.pop("Path", None)
    if image is not None or path is not None:
        out["Image"] = (path or "") if image is None else f"{(path or '').removesuffix('.exe')}{image}" if path else f"C:\\W\\{image.upper() if k % 2 else image}"
    return out


def made_events() -> list[tuple]:
    """(place, kind, *FIELDS) of the made events; missing fields are None."""
    found = [(99, {"Image": "C:\\Temp\\a.exe"}), (1, {}), *[(k, {}) for k in detect.ALWAYS]]
    for kind, _, tests in [*detect.RULES, *detect.TACTICS]:
        for k in range(max([1, *[len(v) for _, _, v in tests]])):
            found.append((kind, _made(tests, k)))
        for i in range(len(tests)):
            found.append((kind, _made(tests[:i] + tests[i + 1 :], i)))
    return [(i, kind, *[fields.get(f) for f in FIELDS]) for i, (kind, fields) in enumerate(found)]


MADE = made_events()


def _events(spark: SparkSession, d: str) -> DataFrame:
    made = spark.createDataFrame(MADE, "place int, kind int, " + ", ".join(f"{f} string" for f in FIELDS))
    fields = F.map_filter(F.create_map(*[x for f in FIELDS for x in (F.lit(f), F.col(f))]), lambda k, v: v.isNotNull())
    made = made.select("place", "kind", fields.alias("fields"))
    dealt = _t(spark, d, "events").select("event_id", F.pmod("event_id", F.lit(len(MADE))).cast("int").alias("place"))
    return dealt.join(F.broadcast(made), "place")


def detection_rules(spark, d):
    """Events that meet each rule."""
    found = _events(spark, d).select("kind", F.explode(detect.matches(F.col("fields"), F.col("kind"))).alias("rule"))
    return found.groupBy("kind", "rule").agg(F.count("*").alias("n"))


def detection_attacks(spark, d):
    """Events of each kind, and those that count."""
    return _events(spark, d).groupBy("kind").agg(F.count("*").alias("n"), F.count_if(detect.is_attack(F.col("fields"), F.col("kind"))).alias("attacks"))


def detection_tactics(spark, d):
    """Events of each kind and tactic; of none, -1."""
    return _events(spark, d).groupBy("kind", detect.tactic(F.col("fields"), F.col("kind"), F.lit(-1)).alias("tactic")).agg(F.count("*").alias("n"))


#: Events of open schema as rows (place, order, field, JSON value).
OPEN = [
    (place, k, field, value)
    for place, fields in enumerate([
        {"Channel": '"Microsoft-Windows-Sysmon/Operational"', "EventID": "1", "Image": json.dumps("C:\\Windows\\System32\\cmd.exe"), "CommandLine": json.dumps('cmd.exe /c "whoami" & net use deadbeef;ab'), "Company": '"Microsoft"', "Signed": "true", "IntegrityLevel": '""'},
        {"EventID": "13", "TargetObject": json.dumps("HKLM\\Software\\Run\\x"), "Details": '"skipped"', "Image": json.dumps("C:\\Users\\bob\\AppData\\Local\\Temp\\A.exe"), "Extra": "3.5", "List": "[1, 2]", "Inner": '{"a": 1}', "None": "null"},
        {"EventID": "3", "DestinationPort": "445", "DestinationHostname": '"srv-1"', "ProcessGuid": '"{1}"', "ParentCommandLine": json.dumps("powershell -Enc `x` 'abc' 1234 éàü"), "SourceImage": json.dumps("/usr/bin/tmp/tool"), "User": json.dumps("CORP\\alice")},
        {"EventID": "11", "TargetFilename": json.dumps("C:\\ProgramData\\Startup\\run.BAT"), "Unknown Field": '"v::w"'},
    ])
    for k, (field, value) in enumerate(fields.items())
]


def open_event_tokens(spark, d):
    """Tokens of open-schema events, which the driver's events are dealt to."""
    rows = sorted({p for p, *_ in OPEN})
    texts = [(p, int(next(v for q, _, f, v in OPEN if q == p and f == "EventID")), "{" + ", ".join(f"{json.dumps(f)}: {v}" for q, _, f, v in OPEN if q == p) + "}") for p in rows]
    made = spark.createDataFrame(texts, "place int, event int, json string")
    dealt = _t(spark, d, "events").select(F.pmod("event_id", F.lit(len(rows))).cast("int").alias("place")).join(F.broadcast(made), "place")
    return dealt.select(F.explode(logs.event_tokens(F.col("json"), F.col("event"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


NOTED = [p[1:] + rest for patterns, _ in T.NOTES for p in patterns for rest in ("", "x")] + ["file.name::lsass", "a::powershell", "Signature::Microsoft Windows", "none", ""]


def token_notes(spark, d):
    """What tokens say, of tokens that begin with or hold each pattern and of the types of the driver's events."""
    made = spark.createDataFrame([(t,) for t in NOTED], "token string").unionByName(_t(spark, d, "events").select(T.token("type", F.col("event_type")).alias("token")))
    return made.groupBy("token", T.note(F.col("token")).alias("note")).agg(F.count("*").alias("n"))


def common_names(spark, d):
    """Common names of fields, sizes in units and places of paths, over documents and made names."""
    fields = F.element_at(F.array(*[F.lit(f) for f in [*T.COMMON_NAMES, "Own"]]), F.pmod("doc_id", F.lit(len(T.COMMON_NAMES) + 1)).cast("int") + 1)
    size = F.col("n_chars").cast("bigint") * F.col("n_chars")
    path = F.concat(F.lit("C:"), F.element_at(F.array(*[F.lit(p.upper()) for p, _ in T.PLACES]), F.pmod("doc_id", F.lit(len(T.PLACES))).cast("int") + 1), F.lit("temp\\x"))
    found = _t(spark, d, "documents").select(T.common_name(fields).alias("name"), T.human_bytes(size).alias("size"), F.array_join(T.place_tokens(path), " ").alias("places"))
    return found.groupBy("name", "size", "places").agg(F.count("*").alias("n"))


N_WINDOWS, N_ROWS = 400, 3000


def window_vocabulary(spark, d):
    """Bits of made ten-minute windows by the vocabulary of all their tokens."""
    events = generators.windows(spark, N_WINDOWS, 1)
    tokens = logs.process_tokens(*[F.col(c) for c in ("image", "parent", "user", "integrity", "company", "signed")])
    vocabulary = logs.window_vocabulary(events, tokens)
    bits = logs.window_bits(events, "window_id", tokens, "image", vocabulary)
    names = logs.window_feature_names([r["token"] for r in vocabulary.orderBy("place").collect()])  # a model's width
    named = spark.createDataFrame(list(enumerate(names)), "bit int, name string")
    return bits.groupBy("bit").agg(F.count("*").alias("n")).join(F.broadcast(named), "bit").select("bit", "name", "n")


def made_flows(spark, d):
    rows = generators.flows(spark, N_ROWS)
    return rows.groupBy("label").agg(F.count("*").alias("n"), *[F.round(F.sum(c), 3).alias(c) for c in generators.FLOW_FIELDS])


def made_records(spark, d):
    """Tokens of made records of one key=value a line, by label."""
    rows = generators.records(spark, N_ROWS).select("label", T.key_values(F.col("raw"), ["Image", "ParentImage", "User", "IntegrityLevel", "Company", "Signed"]).alias("f"))
    tokens = logs.process_tokens(T.basename(F.col("f.Image")), T.basename(F.col("f.ParentImage")), F.col("f.User"), F.col("f.IntegrityLevel"), F.col("f.Company"), F.col("f.Signed"))
    return rows.select("label", F.explode(tokens).alias("token")).groupBy("label", "token").agg(F.count("*").alias("n"))


def made_growing_events(spark, d):
    both = generators.growing_events(spark, N_ROWS).unionByName(generators.growing_events(spark, N_ROWS, True, 3))
    return both.select("label", F.explode("tokens").alias("token")).groupBy("label", "token").agg(F.count("*").alias("n"))


def made_samples(spark, d):
    """The made sets of bits: rows, ones and labels of each."""
    sets = {
        "xor": generators.xor(spark, N_ROWS, 6, 0.1), "target": generators.counted_target(spark, N_ROWS).withColumnRenamed("target", "label"), "row": generators.pattern_row(spark, N_ROWS),
        "image": generators.pattern_image(spark, N_ROWS), "classes": generators.four_classes(spark, N_ROWS),
    }
    out = None
    for name, df in sets.items():
        ones = F.array_join(F.transform("bits", lambda b: b.cast("string")), "")
        part = df.select(F.lit(name).alias("name"), ones.alias("bits"), F.col("label").cast("int").alias("label"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("name", "bits", "label").agg(F.count("*").alias("n"))


def exact_split(spark, d):
    """Rows of both sides of an exact cut."""
    return logs.cut_at(_t(spark, d, "orders").select("o_orderkey"), "o_orderkey").groupBy("train").agg(F.count("*").alias("n"))


def _written(spark: SparkSession, rows: DataFrame, ending: str) -> str:
    """rows, one string column, as text files in the session's shared folder."""
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = f"file://{tempfile.gettempdir()}"
    path = os.path.join(folder, f"rows-{uuid.uuid4().hex}{ending}")
    rows.write.text(path)
    return path


def scan_numeric_csv(spark, d):
    """Orders written as numeric CSV and read again."""
    path = _written(spark, _t(spark, d, "orders").select(F.concat_ws(",", F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.col("o_custkey").cast("string"), (F.col("o_orderkey") % 5 - 1).cast("string")).alias("value")), "")
    rows = loaders.read_numeric_csv(spark, path)
    return rows.groupBy("label").agg(F.count("*").alias("n"), F.round(F.sum(F.get("features", F.lit(0))), 2).alias("price"), F.sum(F.get("features", F.lit(1))).alias("customers"))


def scan_binary_csv(spark, d):
    path = _written(spark, _t(spark, d, "orders").select(F.concat_ws(",", *[(F.col("o_orderkey") % k).cast("string") for k in (2, 3, 5)], (F.col("o_orderkey") % 4).cast("string")).alias("value")), "")
    rows = loaders.read_binary_csv(spark, path)
    return rows.groupBy("label", F.array_join(F.transform("bits", lambda b: b.cast("string")), "").alias("bits")).agg(F.count("*").alias("n"))


def scan_sparse_text(spark, d):
    path = _written(spark, _t(spark, d, "orders").select(F.concat_ws(" ", (F.col("o_orderkey") % 2).cast("string"), *[(F.col("o_orderkey") % k).cast("string") for k in (3, 5, 9)]).alias("value")), "")
    rows = loaders.read_sparse_binary(spark, path, 6)
    return rows.groupBy("label", F.array_join(F.transform("bits", lambda b: b.cast("string")), "").alias("bits")).agg(F.count("*").alias("n"))


def scan_json_events(spark, d):
    """Made events written as line-delimited JSON and read as process events."""
    fields = F.struct(F.lit("Microsoft-Windows-Sysmon/Operational").alias("Channel"), (F.col("event_id") % 3).alias("EventID"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("EventTime"), F.concat(F.lit("C:\\x\\"), F.col("event_type"), F.lit(".EXE")).alias("Image"), F.lit("/a/b").alias("ParentImage"), F.when(F.col("event_id") % 2 == 0, "Google LLC").otherwise("").alias("Company"))
    path = _written(spark, _t(spark, d, "events").select(F.to_json(fields).alias("value")), "")
    return loaders.read_process_events(spark, path, "*").groupBy("image", "parent", "company", "signed", F.unix_date(F.to_date("ts")).alias("day")).agg(F.count("*").alias("n"))


_ENTRIES = [detection_rules, detection_attacks, detection_tactics, open_event_tokens, token_notes, common_names, window_vocabulary, made_flows, made_records, made_growing_events, made_samples, exact_split, scan_numeric_csv, scan_binary_csv, scan_sparse_text, scan_json_events]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ENTRIES}


# SQL.


def _q(value) -> str:
    return "null" if value is None else "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value).lower() if isinstance(value, bool) else f"{value!r}::double" if isinstance(value, float) else str(value)


def _list(values) -> str:
    return "[" + ", ".join(map(_q, values)) + "]"


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(map(_q, r)) + ")" for r in rows)


def _sql_field(name: str) -> str:
    if name in ("Image", "ParentImage", "TargetImage"):
        return rf"lower(regexp_extract(coalesce({name}, ''), '[^\\/]*$'))"
    if name == "Path":
        return "lower(coalesce(Image, ''))"
    if name == "Signed":
        return "coalesce(Signed, 'false')"
    if name == "DestinationPort":
        return "cast(coalesce(try_cast(DestinationPort as usmallint), 0) as varchar)"
    return f"lower(coalesce({name}, ''))" if name in detect.LOWER else f"coalesce({name}, '')"


def _sql_test(name: str, kind: str, values: list) -> str:
    if kind in ("any", "all"):
        return "(" + (" or " if kind == "any" else " and ").join(_sql_test(*t) for t in values) + ")"
    if kind.startswith("not "):
        return f"not {_sql_test(name, kind[4:], values)}"
    value = _sql_field(name)
    if kind == "is":
        return f"list_contains({_list(values)}, {value})"
    if kind == "longer":
        return f"(octet_length(encode({value})) > {values[0]})"
    if kind == "label longer":
        return f"(len(list_filter(string_split({value}, '.'), lambda p: octet_length(encode(p)) > {values[0]})) > 0)"
    number = f"coalesce(try_cast('0x' || regexp_replace({value}, '^(0x)+', '') as bigint), 0)"
    if kind == "bits":
        return f"(({number} & {values[0]}) <> 0)"
    if kind == "least":
        return f"({number} >= {values[0]})"
    one = {"has": "contains", "begins": "starts_with", "ends": "ends_with"}[kind]
    return f"(len(list_filter({_list(values)}, lambda v: {one}({value}, v))) > 0)"


def _sql_rule(kind: int, tests: list) -> str:
    return " and ".join([f"kind = {kind}", *[_sql_test(*t) for t in tests]])


_DEALT = f"made as (select * from (values {_values(MADE)}) as x(place, kind, {', '.join(FIELDS)})), e as (select m.* from events join made m on event_id % {len(MADE)} = m.place)"
_NAMES = {(k, n): [t for k2, n2, t in detect.RULES if (k2, n2) == (k, n)] for k, n, _ in detect.RULES}
_FOUND = ", ".join(f"case when {' or '.join('(' + _sql_rule(k, t) + ')' for t in tests)} then {_q(n)} end" for (k, n), tests in _NAMES.items())
_TACTIC = "case " + " ".join(f"when {_sql_rule(k, t)} then {n}" for k, n, t in detect.TACTICS) + " else -1 end"
_U = "(cast('0x' || substr(md5('{seed}:' || cast({row} as varchar) || ':{place}'), 1, 13) as bigint) / 4503599627370496.0)"


def _u(place: int, row: str = "i", seed: int = 1) -> str:
    return _U.format(seed=seed, row=row, place=place)


def _below(place: int, n: int, row: str = "i", seed: int = 1) -> str:
    return f"cast(floor({_u(place, row, seed)} * {n}) as integer)"


def _pick(place: int, values: list, row: str = "i", seed: int = 1) -> str:
    return f"{_list(values)}[{_below(place, len(values), row, seed)} + 1]"


def _normal(place: int) -> str:
    return f"(sqrt(-2 * ln(greatest(1 - {_u(place)}, 1e-12))) * cos(2 * pi() * {_u(place + 1)}))"


def _either(benign: str, hostile: str) -> str:
    return f"case when bad then {hostile} else {benign} end"


def _sql_flows() -> str:
    g = generators
    ranged = lambda p, a, b: _either(f"{a[0]} + {a[1] - a[0]} * {_u(p)}", f"{b[0]} + {b[1] - b[0]} * {_u(p)}")
    columns = [
        _either(f"-30.0 * ln(1 - {_u(1)})", f"-3.0 * ln(1 - {_u(1)})"), _either(f"exp(7.0 + 1.2 * {_normal(2)})", f"exp(5.0 + 1.0 * {_normal(2)})"), _either(f"exp(8.0 + 1.3 * {_normal(4)})", f"exp(10.0 + 1.0 * {_normal(4)})"),
        ranged(6, (5.0, 200.0), (1.0, 20.0)), ranged(7, (5.0, 300.0), (1.0, 15.0)), _either(_pick(8, g.SERVED_PORTS), _pick(8, g.SCANNED_PORTS)), ranged(9, (0.5, 5.0), (0.0, 0.3)), ranged(10, (0.0, 0.2), (0.6, 1.0)),
    ]
    rows = ", ".join(f"{c} as {n}" for c, n in zip(columns, g.FLOW_FIELDS))
    return f"with b as (select i, {_u(0)} < 0.3 as bad from range({N_ROWS}) x(i)), f as (select bad, {rows} from b) select cast(bad as integer) as label, count(*) as n, {', '.join(f'round(sum({n}), 3) as {n}' for n in g.FLOW_FIELDS)} from f group by bad"


_TOKENS = "['Image::' || image, 'ParentImage::' || parent, 'User::' || usr, 'IntegrityLevel::' || integrity, 'Company::' || company, 'Signed::' || cast(signed as varchar), 'edge::' || parent || '->' || image]"


def _sql_records() -> str:
    g = generators
    base = lambda c: rf"regexp_extract({c}, '[^\\/]*$')"
    return f"""with r as (select {base(_pick(0, g.RECORD_IMAGES))} as image, {base(_pick(1, g.RECORD_PARENTS))} as parent, {_pick(2, g.RECORD_USERS)} as usr, {_pick(3, g.INTEGRITIES)} as integrity, {_pick(4, g.COMPANIES)} as company, {_below(5, 2)} = 0 as signed from range({N_ROWS}) x(i)),
     l as (select *, cast((parent in ('WINWORD.EXE', 'EXCEL.EXE') and image in ('powershell.exe', 'cmd.exe')) or (integrity = 'System' and not signed) as integer) as label from r),
     t as (select label, unnest({_TOKENS}) as token from l) select label, token, count(*) as n from t group by label, token"""


def _sql_growing() -> str:
    g = generators

    def half(programs: list, seed: int, later: bool) -> str:
        at = f"{_below(0, len(programs), seed=seed)} + 1"
        more = f", {_pick(2, g.NEW_PARENTS, seed=seed)}" if later else ""
        return f"select {_list([y for _, y in programs])}[{at}] as label, unnest([{_list([p for p, _ in programs])}[{at}], {_pick(1, g.GROWING_USERS, seed=seed)}{more}]) as token from range({N_ROWS}) x(i)"

    return f"with t as ({half(g.KNOWN_PROGRAMS, 1, False)} union all {half(g.NEW_PROGRAMS, 3, True)}) select label, token, count(*) as n from t group by label, token"


def _sql_samples() -> str:
    bits = lambda ks: "[" + ", ".join(_below(k, 2) for k in ks) + "]"
    own = lambda k: f"(i >> {3 - k}) & 1"
    return f"""with x as (
     select 'xor' as name, {bits(range(6))} as b, {_u(6)} < 0.1 as moved, null as other, i from range({N_ROWS}) x(i)
     union all select 'target', {bits(range(20))}, false, null, i from range({N_ROWS}) x(i)
     union all select 'row', [{', '.join(own(k) for k in range(4))}], false, null, i from range({N_ROWS}) x(i)
     union all select 'image', [{own(0)}, {own(1)}, {_below(2, 2)}, {_below(3, 2)}, {own(2)}, {own(3)}, {_below(6, 2)}, {_below(7, 2)}], false, null, i from range({N_ROWS}) x(i)
     union all select 'classes', {bits(range(8))}, {_u(8)} < 0.05, {_below(9, 4)}, i from range({N_ROWS}) x(i)),
     y as (select name, array_to_string(b, '') as bits, case name when 'xor' then cast((b[1] <> b[2]) <> moved as integer) when 'target' then 20 * list_sum(b[1:5]) when 'row' then cast(b[1] <> b[2] as integer) when 'image' then cast(b[1] <> b[5] as integer)
      else case when moved then other else 2 * cast(b[1] <> b[2] as integer) + cast(b[3] <> b[4] as integer) end end as label from x)
     select name, bits, cast(label as integer) as label, count(*) as n from y group by name, bits, label"""


def _sql_windows() -> str:
    g = generators
    row = "w || '/' || k"
    quiet = f"select w, {_pick(5, g.WINDOW_IMAGES, row)} as image, {_pick(6, g.WINDOW_PARENTS, row)} as parent, {_pick(7, g.INTEGRITIES[:2], row)} as integrity, {_pick(8, g.COMPANIES[:2], row)} as company, true as signed from (select i as w, unnest(range({_below(0, 32)} + 8)) as k from range({N_WINDOWS}) x(i))"
    burst = f"select w, case when k < 0 then 'wscript.exe' else 'powershell.exe' end, case when k < 0 then 'WINWORD.EXE' else 'wscript.exe' end, 'Medium', case when k < 0 then 'Microsoft Corporation' else '<unknown>' end, k < 0 from (select i as w, unnest(range(-1, {_below(3, 6)} + 3)) as k from range({N_WINDOWS}) x(i) where {_below(1, 2)} = 0)"
    return rf"""with e as (select *, 'CORP\alice' as usr from ({quiet} union all {burst})), t as (select w, image, unnest({_TOKENS}) as token from e), v as (select token, row_number() over (order by token) - 1 as place from (select distinct token from t)),
     c as (select w, token, count(*) as c from t group by w, token), s as (select w, count(*) as n, count(distinct image) as d from e group by w), width as (select count(*) * 3 as z from v),
     b as (select place * 3 + j - 1 as bit, 'count(' || token || ') >= ' || cast([1, 3, 10][j] as varchar) as name from c join v using (token), (select unnest([1, 2, 3]) as j) where c >= [1, 3, 10][j]
      union all select z + j - 1, 'window_events >= ' || cast([5, 20, 50, 100][j] as varchar) from s, width, (select unnest([1, 2, 3, 4]) as j) where n >= [5, 20, 50, 100][j]
      union all select z + 3 + j, 'distinct_images >= ' || cast([2, 5, 10][j] as varchar) from s, width, (select unnest([1, 2, 3]) as j) where d >= [2, 5, 10][j])
     select cast(bit as integer) as bit, name, count(*) as n from b group by bit, name"""


_PLACES = f"(select unnest({_list([p for p, _ in T.PLACES])}) as part, unnest({_list([n for _, n in T.PLACES])}) as place, unnest(range({len(T.PLACES)})) as o)"
_SPLIT = r"regexp_split_to_array(lower(v), '[\s,;|&()\"''`]+')"
_NOTE = "case " + " ".join(f"when {' or '.join({'^': 'starts_with(token, {0})', '*': 'contains(token, {0})', '=': 'token = {0}'}[p[0]].format(_q(p[1:])) for p in patterns)} then {_q(text)}" for patterns, text in T.NOTES) + " else '' end"

ORACLE: dict[str, str] = {
    "detection_rules": f"with {_DEALT}, f as (select kind, unnest(list_filter([{_FOUND}], lambda x: x is not null)) as rule from e) select kind, rule, count(*) as n from f group by kind, rule",
    "detection_attacks": f"with {_DEALT}, f as (select kind, list_contains({list(detect.ALWAYS)}, kind) or len(list_filter([{_FOUND}], lambda x: x is not null)) > 0 as a from e) select kind, count(*) as n, count(*) filter (a) as attacks from f group by kind",
    "detection_tactics": f"with {_DEALT} select kind, cast({_TACTIC} as integer) as tactic, count(*) as n from e group by kind, tactic",
    "open_event_tokens": rf"""with made as (select * from (values {_values(OPEN)}) as x(place, k, field, j)), f as (select place, field, json_extract_string(j::json, '$') as v, json_type(j::json) as kind from made),
     kept as (select place, field, coalesce(map {{{', '.join(f"{_q(k)}: {_q(v)}" for k, v in T.COMMON_NAMES.items())}}}[field], field) as name, v from f where kind in ('VARCHAR', 'UBIGINT', 'BIGINT', 'DOUBLE', 'BOOLEAN') and v <> '' and not list_contains({_list(T.SKIPPED_FIELDS)}, field)),
     line as (select place, case field when 'CommandLine' then 'process.args::' else 'process.parent.args::' end || t as token from (select place, field, unnest({_SPLIT}) as t from kept where field in ('CommandLine', 'ParentCommandLine')) where octet_length(encode(t)) >= 3 and not regexp_matches(t, '^[0-9a-f]+$')),
     rest as (select *, len(list_filter({_list(T.EVENT_HIVES)}, lambda h: starts_with(v, h))) > 0 as hive, contains(v, '\') or contains(v, '/') as path from kept where field not in ('CommandLine', 'ParentCommandLine')),
     tok as (select place, token from line union all select place, name || '::' || case when hive then split_part(v, '\', 1) when path then regexp_extract(v, '[^\\/]*$') else v end from rest
      union all select rest.place, 'file.path::' || p.place from rest, {_PLACES} p where path and not hive and contains(lower(v), part) union all select place, 'event.id::' || v from f where field = 'EventID')
     select token, count(*) as n from events join tok on event_id % {len({p for p, *_ in OPEN})} = tok.place group by token""",
    "token_notes": f"with t as (select unnest({_list(NOTED)}) as token union all select 'type::' || event_type from events) select token, {_NOTE} as note, count(*) as n from t group by token",
    "common_names": f"""with x as (select {_list([*T.COMMON_NAMES.values(), 'Own'])}[doc_id % {len(T.COMMON_NAMES) + 1} + 1] as name, cast(n_chars as bigint) * n_chars as s, 'C:' || upper({_list([p for p, _ in T.PLACES])}[doc_id % {len(T.PLACES)} + 1]) || 'temp\\x' as p from documents),
     y as (select name, case when s >= 1073741824 then printf('%.1f GB', s / 1073741824.0) when s >= 1048576 then printf('%.1f MB', s / 1048576.0) when s >= 1024 then printf('%.1f KB', s / 1024.0) else printf('%.1f B', cast(s as double)) end as size,
      array_to_string(list_transform(list_filter({_list([f"{p}|{n}" for p, n in T.PLACES])}, lambda q: contains(lower(p), split_part(q, '|', 1))), lambda q: 'file.path::' || split_part(q, '|', 2)), ' ') as places from x)
     select name, size, places, count(*) as n from y group by all""",
    "window_vocabulary": _sql_windows(),
    "made_flows": _sql_flows(),
    "made_records": _sql_records(),
    "made_growing_events": _sql_growing(),
    "made_samples": _sql_samples(),
    "exact_split": "select train, n from (select true as train, count(*) * 4 // 5 as n from orders union all select false, count(*) - count(*) * 4 // 5 from orders) where n > 0",
    "scan_numeric_csv": "select greatest(0, o_orderkey % 5 - 1) as label, count(*) as n, round(sum(o_totalprice), 2) as price, cast(sum(o_custkey) as double) as customers from orders group by 1",
    "scan_binary_csv": "select o_orderkey % 4 as label, concat(cast(o_orderkey % 2 <> 0 as integer), cast(o_orderkey % 3 <> 0 as integer), cast(o_orderkey % 5 <> 0 as integer)) as bits, count(*) as n from orders group by 1, 2",
    "scan_sparse_text": "select o_orderkey % 2 as label, array_to_string([cast(list_contains([o_orderkey % 3, o_orderkey % 5, o_orderkey % 9], i) as integer) for i in range(6)], '') as bits, count(*) as n from orders group by 1, 2",
    "scan_json_events": "select event_type || '.EXE' as image, 'b' as parent, case when event_id % 2 = 0 then 'Google LLC' else '<unknown>' end as company, event_id % 2 = 0 as signed, cast(cast(ts as date) - date '1970-01-01' as integer) as day, count(*) as n from events where event_id % 3 = 1 group by all",
}
