"""Labelled samples to try models on, each row a function of the seed and its number: no state, no order, any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleweave.functions import draws
from ruleweave.functions.text import basename

ROW = "id"

# Ports, programs, users and companies that made-up records name.
SCANNED_PORTS = [4444.0, 1337.0, 31337.0, 6667.0, 9001.0, 53.0]
SERVED_PORTS = [80.0, 443.0, 53.0, 22.0, 25.0, 8080.0, 3306.0]
FLOW_FIELDS = ["duration", "src_bytes", "dst_bytes", "src_pkts", "dst_pkts", "dport", "iat_var", "syn_ratio"]
RECORD_IMAGES = ["C:\\Windows\\System32\\WindowsPowerShell\\v1.0\\powershell.exe", "C:\\Windows\\System32\\cmd.exe", "C:\\Program Files\\Google\\Chrome\\Application\\chrome.exe", "C:\\Windows\\System32\\svchost.exe"]
RECORD_PARENTS = ["C:\\Program Files\\Microsoft Office\\root\\Office16\\WINWORD.EXE", "C:\\Program Files\\Microsoft Office\\root\\Office16\\EXCEL.EXE", "C:\\Windows\\explorer.exe", "C:\\Windows\\System32\\services.exe"]
RECORD_USERS = ["CORP\\alice", "CORP\\bob", "NT AUTHORITY\\SYSTEM"]
INTEGRITIES = ["Medium", "High", "System"]
COMPANIES = ["Microsoft Corporation", "Google LLC", "<unknown>"]
KNOWN_PROGRAMS = [("proc::explorer.exe", 0), ("proc::winword.exe", 0), ("proc::chrome.exe", 0), ("proc::mimikatz.exe", 1), ("proc::psexec.exe", 1)]
NEW_PROGRAMS = [("proc::outlook.exe", 0), ("proc::teams.exe", 0), ("proc::rundll32.exe", 1), ("proc::certutil.exe", 1)]
GROWING_USERS = ["user::alice", "user::bob", "user::carol"]
NEW_PARENTS = ["parent::services.exe", "parent::explorer.exe"]
WINDOW_IMAGES = ["chrome.exe", "svchost.exe", "notepad.exe", "OUTLOOK.EXE"]
WINDOW_PARENTS = ["explorer.exe", "services.exe"]
WINDOW_SECONDS = 600


def _rows(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n)


def _bits(seed: int, n_features: int) -> Column:
    return F.array(*[draws.below(seed, ROW, k, 2).cast("tinyint") for k in range(n_features)])


def xor(spark: SparkSession, n: int, n_features: int = 12, noise: float = 0.0, seed: int = 1) -> DataFrame:
    """(row_id, bits, label): the label is the first bit or else the second, changed in a share `noise` of the rows."""
    rows = _rows(spark, n).select(ROW, _bits(seed, n_features).alias("bits"))
    label = F.get("bits", F.lit(0)).cast("int").bitwiseXOR(F.get("bits", F.lit(1)).cast("int"))
    flipped = (draws.uniform(seed, ROW, n_features) < noise).cast("int")
    return rows.select(F.col(ROW).alias("row_id"), "bits", label.bitwiseXOR(flipped).alias("label"))


def flows(spark: SparkSession, n: int, malicious: float = 0.3, seed: int = 1) -> DataFrame:
    """(row_id, the eight FLOW_FIELDS, label): network flows, of which a share is malicious."""
    bad = draws.uniform(seed, ROW, 0) < malicious

    def either(benign: Column, hostile: Column) -> Column:
        return F.when(bad, hostile).otherwise(benign)

    def ranged(place: int, benign: tuple, hostile: tuple) -> Column:
        return either(draws.between(seed, ROW, place, *benign), draws.between(seed, ROW, place, *hostile))

    columns = [
        either(draws.exponential(seed, ROW, 1, 30.0), draws.exponential(seed, ROW, 1, 3.0)),
        either(draws.lognormal(seed, ROW, 2, 7.0, 1.2), draws.lognormal(seed, ROW, 2, 5.0, 1.0)),
        either(draws.lognormal(seed, ROW, 4, 8.0, 1.3), draws.lognormal(seed, ROW, 4, 10.0, 1.0)),
        ranged(6, (5.0, 200.0), (1.0, 20.0)),
        ranged(7, (5.0, 300.0), (1.0, 15.0)),
        either(draws.pick(seed, ROW, 8, SERVED_PORTS), draws.pick(seed, ROW, 8, SCANNED_PORTS)),
        ranged(9, (0.5, 5.0), (0.0, 0.3)),
        ranged(10, (0.0, 0.2), (0.6, 1.0)),
    ]
    return _rows(spark, n).select(F.col(ROW).alias("row_id"), *[c.alias(name) for c, name in zip(columns, FLOW_FIELDS)], bad.cast("int").alias("label"))


def records(spark: SparkSession, n: int, seed: int = 1) -> DataFrame:
    """(row_id, raw, label): process events of one `key=value` a line.

    Suspicious is a shell that an office program starts, and what runs unsigned with the system's rights.
    """
    image, parent = draws.pick(seed, ROW, 0, RECORD_IMAGES), draws.pick(seed, ROW, 1, RECORD_PARENTS)
    integrity, signed = draws.pick(seed, ROW, 3, INTEGRITIES), draws.below(seed, ROW, 5, 2) == 0
    shell = F.lower(basename(parent)).isin("winword.exe", "excel.exe") & F.lower(basename(image)).isin("powershell.exe", "cmd.exe")
    values = {"EventID": F.lit("1"), "Image": image, "ParentImage": parent, "User": draws.pick(seed, ROW, 2, RECORD_USERS), "IntegrityLevel": integrity, "Company": draws.pick(seed, ROW, 4, COMPANIES), "Signed": signed.cast("string")}
    raw = F.concat_ws("\n", *[F.concat(F.lit(f"{k}="), v) for k, v in values.items()])
    return _rows(spark, n).select(F.col(ROW).alias("row_id"), raw.alias("raw"), (shell | ((integrity == "System") & ~signed)).cast("int").alias("label"))


def growing_events(spark: SparkSession, n: int, later: bool = False, seed: int = 1) -> DataFrame:
    """(row_id, tokens, label): events of known programs or, `later`, of new ones, which have a column more."""
    programs = NEW_PROGRAMS if later else KNOWN_PROGRAMS
    place = draws.below(seed, ROW, 0, len(programs)) + 1
    tokens = [F.element_at(F.array(*[F.lit(p) for p, _ in programs]), place), draws.pick(seed, ROW, 1, GROWING_USERS)]
    tokens += [draws.pick(seed, ROW, 2, NEW_PARENTS)] * later
    return _rows(spark, n).select(F.col(ROW).alias("row_id"), F.array(*tokens).alias("tokens"), F.element_at(F.array(*[F.lit(y) for _, y in programs]), place).alias("label"))


def windows(spark: SparkSession, n: int, seed: int = 1) -> DataFrame:
    """(window_id, label, time_sec, image, parent, user, integrity, company, signed): events of ten-minute windows.

    Every window has 8 to 39 background events; one of two is suspicious and has
    a script host that an office program starts, and 3 to 8 shells that it starts.
    """
    base = _rows(spark, n).select(F.col(ROW).alias("window_id"), draws.below(seed, ROW, 0, 32).alias("more"), (draws.below(seed, ROW, 1, 2) == 0).alias("bad"), draws.below(seed, ROW, 2, WINDOW_SECONDS).alias("at"), (draws.below(seed, ROW, 3, 6) + 3).alias("shells"))
    start = F.col("window_id") * WINDOW_SECONDS
    name = F.concat(F.col("window_id").cast("string"), F.lit("/"), F.col("k").cast("string"))
    quiet = base.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("more") + 7))).select(
        "window_id", F.col("bad").cast("int").alias("label"), (start + draws.below(seed, name, 4, WINDOW_SECONDS)).alias("time_sec"), draws.pick(seed, name, 5, WINDOW_IMAGES).alias("image"), draws.pick(seed, name, 6, WINDOW_PARENTS).alias("parent"),
        F.lit("CORP\\alice").alias("user"), draws.pick(seed, name, 7, INTEGRITIES[:2]).alias("integrity"), draws.pick(seed, name, 8, COMPANIES[:2]).alias("company"), F.lit(True).alias("signed"),
    )
    burst = base.where("bad").withColumn("k", F.explode(F.sequence(F.lit(-1), F.col("shells") - 1)))
    lead = F.col("k") < 0
    burst = burst.select(
        "window_id", F.lit(1).alias("label"), (start + F.col("at") + F.when(lead, 0).otherwise(draws.below(seed, name, 9, 60))).alias("time_sec"), F.when(lead, "wscript.exe").otherwise("powershell.exe").alias("image"), F.when(lead, "WINWORD.EXE").otherwise("wscript.exe").alias("parent"),
        F.lit("CORP\\alice").alias("user"), F.lit("Medium").alias("integrity"), F.when(lead, "Microsoft Corporation").otherwise("<unknown>").alias("company"), lead.alias("signed"),
    )
    return quiet.unionByName(burst)


def counted_target(spark: SparkSession, n: int, seed: int = 1) -> DataFrame:
    """(row_id, bits, target): 20 bits; the target is 20 times the ones among the first five."""
    rows = _rows(spark, n).select(F.col(ROW).alias("row_id"), _bits(seed, 20).alias("bits"))
    return rows.withColumn("target", 20.0 * F.aggregate(F.slice("bits", 1, 5), F.lit(0), lambda a, b: a + b.cast("int")))


def pattern_row(spark: SparkSession, n: int) -> DataFrame:
    """(row_id, bits, label): all patterns of four bits equally often; the label is the first or else the second."""
    bits = F.array(*[F.call_function("shiftright", F.col(ROW).cast("int"), F.lit(3 - k)).bitwiseAND(F.lit(1)).cast("tinyint") for k in range(4)])
    return _rows(spark, n).select(F.col(ROW).alias("row_id"), bits.alias("bits")).withColumn("label", (F.get("bits", F.lit(0)) != F.get("bits", F.lit(1))).cast("int"))


def pattern_image(spark: SparkSession, n: int, seed: int = 1) -> DataFrame:
    """(row_id, bits, label): 2 x 4 images; the first 2 x 2 block runs through all patterns, the rest is noise, the label is its first column's bits or else."""
    own = lambda k: F.call_function("shiftright", F.col(ROW).cast("int"), F.lit(3 - k)).bitwiseAND(F.lit(1)).cast("tinyint")
    noise = lambda k: draws.below(seed, ROW, k, 2).cast("tinyint")
    bits = F.array(own(0), own(1), noise(2), noise(3), own(2), own(3), noise(6), noise(7))
    return _rows(spark, n).select(F.col(ROW).alias("row_id"), bits.alias("bits")).withColumn("label", (F.get("bits", F.lit(0)) != F.get("bits", F.lit(4))).cast("int"))


def four_classes(spark: SparkSession, n: int, noise: float = 0.05, seed: int = 1) -> DataFrame:
    """(row_id, bits, label): eight bits; two exclusive ors make four classes, of which a share `noise` is drawn anew."""
    rows = _rows(spark, n).select(ROW, _bits(seed, 8).alias("bits"))
    odd = lambda a, b: (F.get("bits", F.lit(a)) != F.get("bits", F.lit(b))).cast("int")
    label = F.when(draws.uniform(seed, ROW, 8) < noise, draws.below(seed, ROW, 9, 4)).otherwise(2 * odd(0, 1) + odd(2, 3))
    return rows.select(F.col(ROW).alias("row_id"), "bits", label.alias("label"))
