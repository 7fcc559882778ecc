"""Detection rules on events with their fields in a map."""

import pytest
from pyspark.sql import functions as F

from ruleweave.functions import detect

EVENTS = [
    (1, {"Image": "C:\\W\\PowerShell.exe", "ParentImage": "C:\\O\\WINWORD.EXE", "CommandLine": "x -Enc y"}, ["office_to_script", "encoded_ps"]),
    (1, {"Image": "C:\\Temp\\a.exe"}, ["staged_exec"]),
    (1, {"Image": "net1.exe", "CommandLine": "net user bob /ADD", "ParentImage": "cmd.exe"}, ["script_to_recon", "create_account"]),
    (1, {}, []),
    (3, {"Image": "cmd.exe", "Initiated": "true", "DestinationPort": "445", "DestinationIp": "10.0.0.1"}, ["ps_nonstandard", "internal_lateral", "smb_lateral"]),
    (3, {"Image": "cmd.exe", "DestinationPort": "445"}, []),
    (15, {"TargetFilename": "a:Zone.Identifier"}, []),
    (15, {"TargetFilename": "a:hidden"}, ["alternate_stream"]),
    (5, {"Image": "c:\\x\\ProcMon.exe"}, ["tool_ended"]),
    (6, {"ImageLoaded": "C:\\TEMP\\x.sys"}, ["unsigned_driver"]),
    (6, {"ImageLoaded": "C:\\TEMP\\x.sys", "Signed": "true", "SignatureStatus": "Valid"}, []),
    (7, {"ImageLoaded": "c:\\temp\\kiwi.dll", "Image": "a\\lsass.exe"}, ["known_library", "staged_library", "unsigned_in_sensitive"]),
    (7, {"ImageLoaded": "c:\\windows\\system32\\a.dll", "Image": "mmc.exe"}, []),
    (10, {"TargetImage": "c:\\lsass.exe", "GrantedAccess": "zz"}, ["credential_access"]),
    (10, {"TargetImage": "services.exe", "GrantedAccess": "0x40"}, ["sensitive_access", "handle_copy"]),
    (10, {"TargetImage": "explorer.exe", "GrantedAccess": "0x1F0FFF"}, ["sensitive_access"]),
    (10, {"TargetImage": "explorer.exe", "GrantedAccess": "0x1fzz"}, []),
    (18, {"PipeName": "\\MSSE-1", "Image": "msbuild.exe"}, ["known_pipe", "scripted_pipe"]),
    (22, {"QueryName": "a" * 41 + ".example.org"}, ["long_label"]),
    (22, {"QueryName": "ab." * 25, "Image": "wmic.exe"}, ["scripted_query", "long_query"]),
    (23, {"TargetFilename": "c:\\x.EVTX", "Image": "cmd.exe"}, ["log_delete", "scripted_delete"]),
    (26, {"TargetFilename": "c:\\Prefetch\\a.pf"}, ["prefetch_delete"]),
    (1, {"Image": "C:\\x\\svchost.exe", "ParentImage": "services.exe"}, ["masquerade"]),
    (1, {"Image": "\\\\srv\\share\\lsass.exe", "ParentImage": "cmd.exe"}, ["hollow_parent", "masquerade", "unc_execution"]),
    (1, {"Image": "lsass.exe"}, []),
    (1, {"Image": "rundll32.exe", "CommandLine": "rundll32 c:\\x\\a.dll,Run"}, ["rundll32_abuse"]),
    (1, {"Image": "rundll32.exe", "CommandLine": "rundll32 c:\\Windows\\System32\\a.dll,Run"}, []),
    (1, {"Image": "at.exe", "CommandLine": ""}, []),
    (3, {"Image": "psexec64.exe", "Initiated": "true", "DestinationPort": "+445"}, ["psexec_smb"]),
    (3, {"Image": "cmd.exe", "Initiated": "true", "DestinationPort": "99999"}, ["ps_nonstandard"]),
    (3, {"Image": "certutil.exe", "Initiated": "true", "DestinationPort": "80"}, ["lolbin_outbound", "http_lolbin"]),
    (11, {"Image": "taskmgr.exe", "TargetFilename": "c:\\lsass.DMP"}, ["memory_dump", "manager_dump"]),
    (11, {"Image": "excel.exe", "TargetFilename": "c:\\x\\a.xll"}, ["scripted_file"]),
    (12, {"TargetObject": "HKLM\\System\\Services\\x\\ImagePath", "Details": "c:\\Temp\\a"}, ["service_path"]),
    (13, {"TargetObject": "HKLM\\x\\InprocServer32\\a"}, ["server_key"]),
    (13, {"TargetObject": "HKLM\\x\\EventLog\\y\\MaxSize"}, ["log_key"]),
    (99, {"Image": "C:\\Temp\\a.exe"}, []),
]

TACTICS = [
    (1, {"ParentImage": "wmiprvse.exe", "Image": "mimikatz.exe"}, detect.LATERAL),
    (1, {"ParentImage": "wmiprvse.exe", "Image": "conhost.exe"}, None),
    (1, {"Image": "procdump64.exe", "CommandLine": "-ma LSASS"}, detect.CREDENTIALS),
    (1, {"Image": "schtasks.exe", "CommandLine": "/create /s host"}, detect.LATERAL),
    (1, {"Image": "schtasks.exe", "CommandLine": "/create /tn x"}, detect.PERSISTENCE),
    (1, {"Image": "whoami.exe", "ParentImage": "explorer.exe"}, detect.DISCOVERY),
    (1, {"Image": "whoami.exe", "ParentImage": "cmd.exe"}, None),
    (1, {"Image": "cmd.exe", "ParentImage": "excel.exe"}, detect.EXECUTION),
    (10, {"TargetImage": "x\\LSASS.exe"}, detect.CREDENTIALS),
    (24, {}, detect.COLLECTION),
    (25, {}, detect.EVASION),
    (7, {}, None),
]


def test_tactics(spark):
    df = spark.createDataFrame([(i, e, f) for i, (e, f, _) in enumerate(TACTICS)], "i int, event int, fields map<string,string>")
    got = df.select("i", detect.tactic(F.col("fields"), F.col("event")).alias("t"), detect.tactic(F.col("fields"), F.col("event"), F.lit(9)).alias("o")).orderBy("i").collect()
    assert [r["t"] for r in got] == [t for _, _, t in TACTICS] and [r["o"] for r in got] == [9 if t is None else t for _, _, t in TACTICS]


def test_rules(spark):
    df = spark.createDataFrame([(i, e, f) for i, (e, f, _) in enumerate(EVENTS)], "i int, event int, fields map<string,string>")
    got = df.select("i", detect.matches(F.col("fields"), F.col("event")).alias("m"), detect.first_match(F.col("fields"), F.col("event"), detect.RULES).alias("f")).orderBy("i").collect()
    assert [r["m"] for r in got] == [m for _, _, m in EVENTS]
    assert [r["f"] for r in got] == [m[0] if m else None for _, _, m in EVENTS]


@pytest.mark.parametrize("event", detect.ALWAYS)
def test_kinds_that_always_count(spark, event):
    df = spark.createDataFrame([(event, {})], "event int, fields map<string,string>")
    assert df.select(detect.is_attack(F.col("fields"), F.col("event"))).first()[0]
