"""Expressions that turn log records into tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Registry hives that begin a registry path.
HIVES = ("HKLM", "HKCU", "HKCR", "HKU", "HKEY_LOCAL_MACHINE", "HKEY_CURRENT_USER", "HKEY_CLASSES_ROOT", "HKEY_USERS", r"\REGISTRY")
#: What separates the tokens of a command line.
SEPARATORS = r"""[\s,;|&()"'`]+"""


def basename(path: Column) -> Column:
    """What follows the last slash of either kind."""
    return F.element_at(F.split(path, r"[\\/]"), -1)


def hive(path: Column) -> Column:
    """What stands before the first backslash."""
    return F.substring_index(path, "\\", 1)


def is_hive(path: Column, hives: tuple[str, ...] = HIVES) -> Column:
    found = F.lit(False)
    for h in hives:
        found = found | F.startswith(path, F.lit(h))
    return found


def column_prefix(token: Column) -> Column:
    """What stands before the first `::`, or the whole token."""
    return F.substring_index(token, "::", 1)


def token(column: str, value: Column) -> Column:
    return F.concat(F.lit(f"{column}::"), value)


def command_tokens(command: Column) -> Column:
    """Lower-case parts of three bytes or more that aren't hexadecimal digits alone."""
    parts = F.split(F.lower(command), SEPARATORS)
    return F.filter(parts, lambda t: (F.octet_length(t) >= 3) & ~t.rlike("^[0-9a-f]+$"))


def key_values(record: Column, fields: list[str]) -> Column:
    """The listed fields of a record with one `key=value` a line, split at the first `=`; missing ones are empty."""
    lines = F.filter(F.split(record, "\r?\n"), lambda line: F.instr(line, "=") > 0)
    pairs = F.transform(lines, lambda line: F.struct(F.trim(F.substring_index(line, "=", 1)).alias("k"), F.trim(F.substr(line, F.instr(line, "=") + 1)).alias("v")))
    value = lambda f: F.coalesce(F.try_element_at(F.filter(pairs, lambda p: p["k"] == f), F.lit(-1))["v"], F.lit(""))
    return F.struct(*[value(f).alias(f) for f in fields])


def time_of_day(stamp: Column) -> Column:
    """Timestamp of `YYYY-MM-DD HH:MM:SS...`; null if it isn't one."""
    return F.try_to_timestamp(F.substring(stamp, 1, 19), F.lit("yyyy-MM-dd HH:mm:ss"))


# Parts of lower-case paths and the places they stand for.
PLACES = [("\\temp\\", "Temp"), ("/tmp/", "Temp"), ("\\users\\", "Users"), ("\\appdata\\", "AppData"), ("\\roaming\\", "Roaming"), ("\\local\\", "LocalAppData"), ("\\desktop\\", "Desktop"), ("\\downloads\\", "Downloads"), ("\\startup\\", "Startup"), ("\\system32\\", "System32"), ("\\syswow64\\", "SysWow64"), ("\\programdata\\", "ProgramData"), ("\\public\\", "Public")]
# Beginnings of registry paths in open-schema events.
EVENT_HIVES = ["HKLM\\", "HKCU\\", "HKU\\", "HKCR\\", "HKCC\\", "HKEY_LOCAL_MACHINE\\", "HKEY_CURRENT_USER\\", "HKEY_USERS\\", "HKEY_CLASSES_ROOT\\"]
# Fields that name nothing worth a token.
SKIPPED_FIELDS = ["ProcessGuid", "ParentProcessGuid", "SourceProcessGUID", "TargetProcessGUID", "LogonGuid", "ProviderGuid", "ProcessId", "ParentProcessId", "SourceProcessId", "TargetProcessId", "SourceThreadId", "ThreadID", "ExecutionProcessID", "LogonId", "TerminalSessionId", "SourcePort", "SourcePortName", "port", "@timestamp", "UtcTime", "TimeCreated", "SystemTime", "EventTime", "EventReceivedTime", "CreationUtcTime", "ParentCreationUtcTime", "@version", "CallTrace", "Hashes", "Details", "SourceModuleName", "SourceModuleType", "Channel", "Computer", "Hostname", "host", "Keywords", "Level", "Message", "Opcode", "Path", "RecordID", "EventRecordID", "RecordNumber", "SourceName", "Task", "Version", "ProcessID", "AccountName", "AccountType", "EventID"]
# Common names of fields.
COMMON_NAMES = {
    "Image": "process.name",
    "ParentImage": "process.parent.name",
    "User": "user.name",
    "IntegrityLevel": "process.integrity_level",
    "Company": "process.pe.company",
    "Signed": "process.code_signature.exists",
    "SignatureStatus": "process.code_signature.status",
    "OriginalFileName": "process.pe.original_file_name",
    "Description": "process.pe.description",
    "Product": "process.pe.product",
    "FileVersion": "process.pe.file_version",
    "CurrentDirectory": "process.working_directory",
    "SourceImage": "source.process.name",
    "TargetImage": "target.process.name",
    "GrantedAccess": "target.process.granted_access",
    "ImageLoaded": "dll.name",
    "DestinationPort": "destination.port",
    "DestinationHostname": "destination.hostname",
    "DestinationPortName": "destination.service",
    "Protocol": "network.transport",
    "Initiated": "network.direction",
    "TargetFilename": "file.name",
    "TargetObject": "registry.path",
    "PipeName": "pipe.name",
    "QueryName": "dns.question.name",
    "QueryStatus": "dns.response_code",
    "IsExecutable": "file.executable",
    "EventType": "event.action",
    "Device": "device.id",
    "Archived": "file.archived",
}
# How a token begins (^), what it is (=) or holds (*), and what that says; the first that fits counts.
NOTES = [
    (["^event.id::1 ", "=event.id::1"], "Sysmon: process creation"),
    (["^event.id::3 ", "=event.id::3"], "Sysmon: network connection"),
    (["^event.id::7 ", "=event.id::7"], "Sysmon: image/DLL loaded"),
    (["^event.id::10"], "Sysmon: process access (injection / cred dump)"),
    (["^event.id::11"], "Sysmon: file created"),
    (["^event.id::12", "^event.id::13", "^event.id::14"], "Sysmon: registry create/set/delete"),
    (["^event.id::22"], "Sysmon: DNS query"),
    (["^event.id::25"], "Sysmon: process tampering"),
    (["^process.name::"], "executing process binary"),
    (["^process.args::"], "command-line argument token"),
    (["^process.parent.name::", "^process.parent::"], "parent process"),
    (["^target.process.name::"], "victim process (accessed/injected)"),
    (["^source.process.name::"], "accessor/injecting process"),
    (["^target.process.granted_access::"], "access rights requested (PROCESS_VM_READ etc.)"),
    (["^file.path::Temp", "*::Temp"], "staging in temp directory (common dropper)"),
    (["^file.path::System32"], "system directory (legit or DLL hijack)"),
    (["^file.path::AppData"], "user profile staging area"),
    (["^file.path::"], "file location"),
    (["^file.name::"], "file name"),
    (["^dll.name::"], "DLL loaded"),
    (["^network.destination", "^destination."], "outbound C2 / lateral target"),
    (["^dns.question::"], "DNS lookup (C2 beacon / lateral)"),
    (["^registry."], "registry operation"),
    (["*::lsass"], "LSASS — credential store (high value target)"),
    (["*::mimikatz", "*::mimi"], "Mimikatz credential dumper"),
    (["*::powershell", "*::psh"], "PowerShell execution"),
    (["*::cmd.exe"], "Command prompt execution"),
    (["*::rundll32"], "LOLBin: runs arbitrary DLLs"),
    (["*::regsvr32"], "LOLBin: runs COM/SCT payloads"),
    (["*::mshta"], "LOLBin: runs HTML/VBS/JS"),
    (["*::wmic"], "WMI execution / lateral movement"),
    (["*::schtasks", "*::at.exe"], "scheduled task (persistence)"),
    (["*::net.exe", "*::net1.exe"], "domain/user enumeration"),
    (["*Signature::Microsoft Windows"], "Microsoft-signed binary (very common — not specific)"),
    (["*code_signature.status::Valid"], "valid code signature (most legit processes)"),
    (["*UserID::S-1-5-18"], "SYSTEM account"),
    (["*UserID::S-1-5-19", "*UserID::S-1-5-20"], "LOCAL/NETWORK SERVICE account"),
]


def place_tokens(path: Column) -> Column:
    """`file.path::` tokens of the places that a path goes through, in their order."""
    lower = F.lower(path)
    return F.array_compact(F.array(*[F.when(F.contains(lower, F.lit(part)), F.lit(f"file.path::{name}")) for part, name in PLACES]))


def common_name(field: Column) -> Column:
    """The common name of a field, or its own."""
    names = F.create_map(*[F.lit(x) for pair in COMMON_NAMES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, field), field)


def note(token: Column) -> Column:
    """What a token says, by the first of NOTES that fits; empty if none does."""
    kinds = {"^": F.startswith, "*": F.contains, "=": lambda a, b: a == b}
    out = F.lit("")
    for patterns, text in reversed(NOTES):
        fits = F.lit(False)
        for p in patterns:
            fits = fits | kinds[p[0]](token, F.lit(p[1:]))
        out = F.when(fits, F.lit(text)).otherwise(out)
    return out


def human_bytes(size: Column) -> Column:
    """A number of bytes in B, KB, MB or GB (of 1024), with one decimal; halves go to the even one."""
    out = F.lit(None).cast("string")
    for power, unit in ((0, "B"), (1, "KB"), (2, "MB"), (3, "GB")):
        scaled = F.concat(F.format_string("%.1f", F.bround(size.cast("double") / float(1024**power), 1)), F.lit(f" {unit}"))
        out = scaled if power == 0 else F.when(size >= 1024**power, scaled).otherwise(out)
    return out
