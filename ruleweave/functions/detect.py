"""Detection rules as data: a rule is a conjunction of tests, a rule set is a disjunction of rules.

A test is (field, kind, values): some value must be equal (`is`), contained
(`has`), a prefix (`begins`) or a suffix (`ends`); `not ...` is the negation;
`longer` compares bytes, `label longer` those of a part between dots; `bits` asks
for some bit of a mask and `least` for a number, both of hexadecimal text that
reads as 0 if it isn't; `any` and `all` have tests for values. Fields come from
an event's string map: images as lower-case base names, Path (the whole image
path) and those in LOWER in lower case, ports as numbers from 0 to 65535 (0 if
they aren't), others as they stand. A missing field is empty, but Signed is
`false`. Rules may share a name; kinds that always count are in ALWAYS. TACTICS
are rules whose order is their priority.

Rules are expressions, so Spark compiles them into the scan; no row leaves the JVM.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ruleweave.functions.text import basename

# Event kinds that count by themselves.
ALWAYS = (2, 8, 9, 14, 16, 19, 20, 21, 24, 25, 28)

# Names of programs.
OFFENSIVE = ["mimikatz.exe", "rubeus.exe", "sharpdpapi.exe", "sharpdump.exe", "procdump.exe", "procdump64.exe", "wce.exe", "fgdump.exe", "psexec.exe", "psexec64.exe", "psexesvc.exe", "paexec.exe", "sharpview.exe", "seatbelt.exe", "bloodhound.exe", "sharphound.exe", "ncat.exe", "nc.exe", "covenantgruntstager.exe", "lazagne.exe", "pwdump.exe", "pwdump6.exe", "pwdump7.exe", "gsecdump.exe", "cachedump.exe", "winhex.exe", "adfind.exe", "adrecon.exe", "ldapdomaindump.exe", "kerbrute.exe", "kekeo.exe", "safetykatz.exe", "sharpkatz.exe", "nanodump.exe", "dumpert.exe", "handlekatz.exe", "crackmapexec.exe", "impacket-secretsdump.exe", "invoke-mimikatz.exe", "invoke-ninjacopy.exe", "sharpchisel.exe", "chisel.exe", "ligolo.exe", "rpivot.exe", "cobaltstrike.exe", "beacon.exe", "brute_ratel.exe", "nighthawk.exe", "accesschk.exe", "accesschk64.exe"]
OFFICE = ["winword.exe", "excel.exe", "powerpnt.exe", "outlook.exe", "onenote.exe", "msaccess.exe", "mspub.exe", "visio.exe", "eqnedt32.exe"]
DROPPED = ["powershell.exe", "cmd.exe", "wscript.exe", "cscript.exe", "mshta.exe", "regsvr32.exe", "rundll32.exe", "certutil.exe", "bitsadmin.exe", "curl.exe", "wget.exe", "msiexec.exe", "installutil.exe", "msbuild.exe"]
PROXY_PARENTS = ["msbuild.exe", "installutil.exe", "regasm.exe", "regsvcs.exe", "ieexec.exe", "cmstp.exe", "odbcconf.exe", "xwizard.exe", "dnscmd.exe", "esentutl.exe", "certutil.exe", "bitsadmin.exe", "msiexec.exe", "regsvr32.exe", "mshta.exe", "wmic.exe", "hh.exe", "pcalua.exe", "syncappvpublishingserver.exe", "appsyncpublishingserver.exe", "presentationhost.exe", "diskshadow.exe", "msconfig.exe", "wab.exe", "extrac32.exe"]
HOSTS = ["powershell.exe", "cmd.exe", "wscript.exe", "cscript.exe", "mshta.exe"]
SCRIPTED = ["powershell.exe", "cmd.exe", "wscript.exe", "cscript.exe"]
SHELLS = ["powershell.exe", "cmd.exe", "wscript.exe", "cscript.exe", "mshta.exe", "regsvr32.exe", "rundll32.exe"]
SYSTEM = ["lsass.exe", "spoolsv.exe", "winlogon.exe", "dllhost.exe", "taskhost.exe", "taskhostw.exe", "userinit.exe"]
ELEVATED = ["fodhelper.exe", "eventvwr.exe", "sdclt.exe", "wsreset.exe", "computerdefaults.exe", "slui.exe", "cmstp.exe", "dccw.exe", "mavinject.exe"]
RECON = ["whoami.exe", "net.exe", "net1.exe", "nltest.exe", "ipconfig.exe", "systeminfo.exe", "tasklist.exe", "arp.exe", "nslookup.exe", "ping.exe", "netstat.exe", "query.exe", "dsquery.exe", "dsget.exe", "gpresult.exe", "reg.exe", "sc.exe", "wmic.exe", "schtasks.exe", "at.exe", "attrib.exe", "dir.exe", "tree.exe", "nbtscan.exe", "nmap.exe", "masscan.exe", "fsutil.exe", "auditpol.exe", "bcdedit.exe", "dnscmd.exe", "wevtutil.exe", "vssadmin.exe", "diskshadow.exe"]
REMOTE = ["cmd.exe", "powershell.exe", "net.exe", "whoami.exe", "ipconfig.exe", "systeminfo.exe", "tasklist.exe"]
MACRO_CHILDREN = ["cmd.exe", "powershell.exe", "net.exe", "whoami.exe", "ipconfig.exe", "systeminfo.exe", "reg.exe", "wmic.exe"]
WEB_SERVERS = ["w3wp.exe", "httpd.exe", "nginx.exe", "apache.exe", "apache2.exe", "tomcat.exe", "php-cgi.exe"]
WEB_CHILDREN = ["cmd.exe", "powershell.exe", "net.exe", "whoami.exe", "hostname.exe", "systeminfo.exe", "ipconfig.exe", "wscript.exe"]
SERVICES = ["svchost.exe", "spoolsv.exe", "lsass.exe", "lsm.exe", "csrss.exe", "wininit.exe", "taskhost.exe", "taskhostw.exe", "msdtc.exe", "vds.exe", "wbengine.exe", "dfsr.exe", "dfsrs.exe", "dns.exe", "ismserv.exe", "ntfrs.exe", "netlogon.exe"]
MASKED = ["svchost.exe", "smss.exe", "csrss.exe", "wininit.exe", "winlogon.exe", "lsass.exe", "services.exe", "spoolsv.exe", "taskhost.exe", "explorer.exe"]
ACCESSIBILITY = ["sethc.exe", "utilman.exe", "osk.exe", "narrator.exe", "magnify.exe", "displayswitch.exe", "atbroker.exe"]
WMI_QUIET = ["conhost.exe", "wbemcons.exe", "wbemcore.exe"]
OUTBOUND = ["mshta.exe", "regsvr32.exe", "wscript.exe", "cscript.exe", "certutil.exe", "bitsadmin.exe", "wmic.exe", "rundll32.exe", "odbcconf.exe", "cmstp.exe", "msbuild.exe", "installutil.exe", "regasm.exe", "regsvcs.exe", "ieexec.exe", "xwizard.exe", "dnscmd.exe", "msiexec.exe", "esentutl.exe", "expand.exe", "extrac32.exe", "hh.exe", "makecab.exe", "msdt.exe", "pcalua.exe", "rpcping.exe", "verclsid.exe", "wab.exe", "wusa.exe", "presentationhost.exe", "diskshadow.exe", "bash.exe", "forfiles.exe", "appvlp.exe"]
HTTP_PROXIES = ["wscript.exe", "cscript.exe", "mshta.exe", "rundll32.exe", "regsvr32.exe", "msbuild.exe", "installutil.exe", "regasm.exe", "certutil.exe", "bitsadmin.exe", "wmic.exe", "cmstp.exe"]
TOOLS = ["msmpeng.exe", "msseces.exe", "mbam.exe", "mbamtray.exe", "avgnt.exe", "avp.exe", "avguard.exe", "avgwdsvc.exe", "sysmon.exe", "sysmon64.exe", "winlogbeat.exe", "elastic-agent.exe", "wireshark.exe", "processhacker.exe", "procmon.exe", "procmon64.exe", "autoruns.exe", "autorunsc.exe", "regedit.exe", "fltmc.exe", "bds-vision.exe", "eguiproxy.exe"]
SENSITIVE = ["lsass.exe", "winlogon.exe", "csrss.exe", "wininit.exe", "services.exe", "svchost.exe"]
SERVERS = ["dllhost.exe", "mmc.exe", "excel.exe", "outlook.exe", "svchost.exe"]
TARGETS = ["winlogon.exe", "csrss.exe", "wininit.exe", "services.exe", "explorer.exe", "svchost.exe", "spoolsv.exe", "taskhost.exe", "taskhostw.exe", "vaultcvc.exe", "msmpeng.exe", "msseces.exe"]
RESOLVERS = ["powershell.exe", "cmd.exe", "wscript.exe", "cscript.exe", "mshta.exe", "rundll32.exe", "regsvr32.exe", "certutil.exe", "bitsadmin.exe", "wmic.exe", "msbuild.exe", "installutil.exe"]
WRITERS = ["powershell.exe", "cmd.exe", "wscript.exe", "cscript.exe", "mshta.exe", "python.exe", "wmic.exe", "regsvr32.exe", "rundll32.exe", "msbuild.exe", "cmstp.exe", "certutil.exe", "bitsadmin.exe", "excel.exe", "winword.exe", "outlook.exe", "onenote.exe", "msaccess.exe", "curl.exe", "expand.exe"]
DUMPERS = ["mimikatz.exe", "rubeus.exe", "kekeo.exe", "safetykatz.exe", "sharpkatz.exe", "nanodump.exe", "dumpert.exe", "wce.exe", "fgdump.exe", "pwdump.exe", "pwdump6.exe", "pwdump7.exe", "gsecdump.exe", "cachedump.exe", "lazagne.exe"]
ENUMERATORS = ["whoami.exe", "hostname.exe", "ipconfig.exe", "systeminfo.exe", "arp.exe", "nslookup.exe", "tasklist.exe", "quser.exe", "qwinsta.exe", "gpresult.exe", "nltest.exe", "dsquery.exe"]

# Parts of command lines, paths, libraries, pipes, registry paths and addresses.
STAGING = ["\\temp\\", "\\appdata\\", "\\public\\", "\\programdata\\", "\\downloads\\"]
STAGED_PATHS = ["\\temp\\", "\\appdata\\local\\temp", "\\users\\public\\", "\\programdata\\", "\\downloads\\"]
DRIVER_PATHS = ["\\temp\\", "\\appdata\\", "\\users\\public\\", "\\programdata\\", "\\downloads\\"]
WRITTEN_PATHS = ["\\temp\\", "\\appdata\\local\\temp", "\\appdata\\roaming\\", "\\public\\", "\\programdata\\", "\\downloads\\", "\\users\\default\\"]
WRITTEN_ENDS = [".exe", ".dll", ".ps1", ".bat", ".vbs", ".js", ".hta", ".jse", ".wsf", ".vbe", ".scr", ".pif", ".cpl", ".inf", ".sys", ".ocx", ".xll"]
ENCODED = ["-encodedcommand", " -enc ", " -ec ", "-nop", "-bypass", "hidden", "iex(", "iex (", "invoke-expression", "downloadstring", "net.webclient", "bitstransfer", "start-bitstransfer", "webclient", "frombase64string"]
STOPPED_SERVICES = ["windefend", "wdnissvc", "sense", "msseces", "sfc", "wscsvc", "securityhealthservice", "stop", "delete"]
KILLED = ["msmpeng", "msseces", "mbam", "avp.exe", "avgnt", "eav_trial"]
DISARMED = ["set-mppreference", "disablerealtimemonitoring", "disablebehaviormonitoring", "disableioavprotection", "add-mppreference -exclusion"]
TASK_PAYLOADS = ["powershell", "cmd.exe", "wscript", "cscript", "mshta", "regsvr32", "rundll32", "\\temp\\", "\\appdata\\", "encodedcommand", "http"]
SERVICE_PAYLOADS = ["\\temp\\", "\\appdata\\", "\\public\\", "\\programdata\\", "\\users\\", "cmd.exe", "powershell", "rundll32"]
CHANGED_SERVICES = ["powershell", "cmd.exe", "\\temp\\", "\\appdata\\", "rundll32", "mshta"]
PROXIED = ["javascript:", "mshtml", "pcwutl.dll", "ieadvpack", "setupapi", "shdocvw", "control_rundll", ",shellexec_rundll"]
TOKENS = ["seimpersonateprivilege", "[system.security.principal]", "windowsidentity::impersonate", "impersonateloggedonuser", "duplicatetoken"]
HASHES = ["sekurlsa::pth", "sekurlsa::wdigest", "lsadump::dcsync", "lsadump::sam", "lsadump::lsa", "kerberos::ptt", "token::elevate", "privilege::debug"]
TRANSFERS = ["/create", "/addfile", "/transfer", "/setnotifycmdline", "/resume", "/setnotifyflags"]
HIDDEN_PATHS = ["\\recycler\\", "\\$recycle.bin\\", "\\systemvolumeinformation\\", "\\windows\\debug\\"]
SEARCHES = ["get-unattendedinstallfile", "get-cachedgpppassword", "get-registryautologon", "get-sitelistpassword"]
PIPE_PATHS = ["\\pipe\\", "\\\\.\\pipe"]
SYSTEM_PATHS = ["\\windows\\system32\\", "\\windows\\syswow64\\"]
INSTALLED = ["\\windows\\system32\\", "\\windows\\syswow64\\", "\\program files\\"]
DRIVERS = ["dbutil_2_3", "mhyprot2", "gdrv.sys", "asmmap", "rtcore64", "zamguard", "ene_io", "physmem", "wfp_test", "procexp"]
LIBRARIES = ["mimilib", "kiwi.dll", "sekurlsa", "wceaux.dll", "reflective", "payload.dll", "beacon.dll", "inject.dll", "cobaltstrike"]
PIPES = ["postex_", "msse-", "status_", "msagent_", "ntsvcs-", "46a9e56", "583da945", "wkssvc-", "isapi_", "dce_pipe", "gruntstager", "interprocess_", "atctl", "gecko_channel"]
CLEANED = [".exe", ".dll", ".dmp", ".evtx", ".ps1", ".bat"]
PRIVATE = ["10.", "172.16.", "172.17.", "172.18.", "172.19.", "172.2", "172.3", "192.168."]
REGISTRY = ["\\run\\", "\\runonce\\", "\\runonceex\\", "userinitmprlogonscript", "\\currentversion\\winlogon", "\\currentversion\\windows\\load", "\\policies\\explorer\\run", "\\securityproviders\\", "minint", "\\image file execution options\\", "\\appcompatflags\\", "\\lsa\\", "\\safeboot\\", "\\sessionmanager\\", "\\bootexecute", "\\knowndlls\\", "\\command processor\\autorun", "\\active setup\\", "\\browser helper objects\\", "userinit", "\\netsh\\", "\\print\\monitors\\", "\\print\\providers\\", "\\terminal server\\", "\\wbem\\", "\\environment\\comspec", "\\policies\\system\\enablelua", "\\disableantispy", "\\audit\\", "\\software\\classes\\ms-settings\\", "\\software\\classes\\mscfile\\", "\\software\\classes\\exefile\\", "\\software\\classes\\clsid\\", "\\windows defender\\", "\\disablerealtimemonitoring", "\\disablebehaviormonitoring", "\\disableioavprotection", "\\disableantispyware", "\\windows error reporting\\disabled", "\\crashcontrol\\crashdumpenabled", "safedllsearchmode", "\\minint", "common startup", "appinit_dlls", "scrnsave.exe", "scrnsave", "\\security packages"]
SERVICE_DETAILS = ["\\temp\\", "\\appdata\\", "\\public\\", "\\programdata\\", "powershell", "cmd.exe", "rundll32", "mshta"]
LOG_KEYS = ["\\start", "\\file", "\\maxsize", "\\autobackuplogfiles"]

UNSIGNED = ("", "any", [("Signed", "is", ["false"]), ("SignatureStatus", "not is", ["Valid"])])
OUT = ("Initiated", "is", ["true"])
LOWER = ("CommandLine", "TargetFilename", "ImageLoaded", "PipeName", "QueryName", "TargetObject", "Details")


def _process(name: str, images: list[str] | None = None, *tests: tuple, parents: list[str] | None = None) -> tuple:
    """A rule of process creation."""
    own = [("ParentImage", "is", parents)] * (parents is not None) + [("Image", "is", images)] * (images is not None)
    return (1, name, [*own, *tests])


def _line(*values: str) -> tuple:
    return ("CommandLine", "has", list(values))


#: (event kind, name, tests).
RULES = [
    _process("attack_tool", OFFENSIVE),
    _process("office_to_script", DROPPED, parents=OFFICE),
    _process("lolbin_to_script", SHELLS, parents=PROXY_PARENTS),
    _process("script_to_recon", RECON, parents=HOSTS),
    _process("system_spawns_shell", SHELLS, parents=SYSTEM),
    _process("encoded_ps", ["powershell.exe"], _line(*ENCODED)),
    _process("certutil_abuse", ["certutil.exe"], _line("-decode", "-decodehex", "-urlcache", "-verifyctl", "http")),
    _process("script_from_staging", ["wscript.exe", "cscript.exe"], _line(*STAGING)),
    _process("staged_exec", None, ("Path", "ends", [".exe"]), ("Path", "has", STAGED_PATHS)),
    _process("uac_bypass", ELEVATED),
    _process("impair_defenses", ["sc.exe"], _line(*STOPPED_SERVICES)),
    _process("impair_defenses", ["taskkill.exe"], _line(*KILLED)),
    _process("impair_defenses", ["powershell.exe"], _line(*DISARMED)),
    _process("impair_defenses", ["auditpol.exe"], _line("/set"), _line("success:disable", "failure:disable", "/clear")),
    _process("clear_logs", ["wevtutil.exe"], _line(" cl ", " clear-log ", " sl ", "/ms:0")),
    _process("clear_logs", ["powershell.exe"], _line("clear-eventlog", "remove-eventlog")),
    _process("clear_logs", ["cmd.exe"], _line("wevtutil"), _line("cl ")),
    _process("inhibit_recovery", ["vssadmin.exe"], _line("delete", "shadows")),
    _process("inhibit_recovery", ["bcdedit.exe"], _line("recoveryenabled", "no", "bootstatuspolicy", "ignoreallfailures")),
    _process("inhibit_recovery", ["wbadmin.exe"], _line("delete", "catalog", "systemstatebackup")),
    _process("inhibit_recovery", ["powershell.exe"], _line("get-wmiobject win32_shadowcopy", ".delete()")),
    _process("create_account", ["net.exe", "net1.exe"], _line("user"), _line("/add")),
    _process("malicious_service", ["sc.exe"], _line("create"), _line(*SERVICE_PAYLOADS)),
    _process("modify_service", ["sc.exe"], _line("config"), _line(*CHANGED_SERVICES)),
    _process("schtask_attack", ["schtasks.exe"], _line("/create"), _line(*TASK_PAYLOADS)),
    _process("winrm_exec", REMOTE, parents=["wsmprovhost.exe"]),
    _process("wsl_exec", ["wsl.exe", "bash.exe"], _line("-c ", "curl", "wget", "python", "nc ", "ncat")),
    _process("reg_dump", ["reg.exe"], _line("save"), _line("sam", "system", "security", "ntds")),
    _process("wmi_exec", ["wmic.exe"], _line("/node:")),
    _process("wmi_exec", ["wmic.exe"], _line("process"), _line("call")),
    _process("wmi_exec", None, ("Image", "not is", WMI_QUIET), parents=["wmiprvse.exe"]),
    _process("dcom_exec", SHELLS, parents=["mmc.exe", "dllhost.exe"]),
    _process("rundll32_abuse", ["rundll32.exe"], _line(*PROXIED)),
    _process("rundll32_abuse", ["rundll32.exe"], _line(".dll,"), ("CommandLine", "not has", ["\\system32\\"])),
    _process("service_spawn", None, ("Image", "not is", SERVICES), parents=["services.exe"]),
    _process("net_lateral", ["net.exe", "net1.exe"], _line(" use ", " session ")),
    _process("token_abuse", ["runas.exe"]),
    _process("token_abuse", ["powershell.exe"], _line(*TOKENS)),
    _process("pth_attack", None, _line(*HASHES)),
    _process("vbs_exec", MACRO_CHILDREN, parents=["mshta.exe", "wscript.exe", "cscript.exe"]),
    _process("mshta_abuse", ["mshta.exe"], _line("http", "javascript:", "vbscript:", "about:")),
    _process("fltmc_unload", ["fltmc.exe"], _line("unload")),
    _process("getsystem_pipe", None, _line("echo"), _line(*PIPE_PATHS)),
    *[
        _process("hollow_parent", [image], ("ParentImage", "not is", ["", *parents]))
        for image, parents in [
            ("smss.exe", ["smss.exe", "system"]),
            ("csrss.exe", ["smss.exe", "svchost.exe"]),
            ("wininit.exe", ["smss.exe"]),
            ("winlogon.exe", ["smss.exe"]),
            ("lsass.exe", ["wininit.exe", "winlogon.exe"]),
            ("services.exe", ["wininit.exe"]),
            ("spoolsv.exe", ["services.exe"]),
            ("userinit.exe", ["dwm.exe", "winlogon.exe", "explorer.exe"]),
        ]
    ],
    _process("masquerade", MASKED, ("Path", "has", ["\\"]), ("Path", "not has", SYSTEM_PATHS)),
    _process("procdump_lsass", None, ("Image", "begins", ["procdump"]), _line("lsass", "-ma")),
    _process("certutil_cert", ["certutil.exe"], _line("-exportpfx")),
    _process("msiexec_remote", ["msiexec.exe"], _line("http://", "https://")),
    _process("msiexec_remote", ["msiexec.exe"], _line("/i"), _line("\\\\")),
    _process("savecred", None, _line("/savecred")),
    _process("accessibility_backdoor", parents=ACCESSIBILITY),
    _process("webshell_exec", WEB_CHILDREN, parents=WEB_SERVERS),
    _process("bits_abuse", ["bitsadmin.exe"], _line(*TRANSFERS)),
    _process("suspicious_location", None, ("Path", "has", HIDDEN_PATHS)),
    _process("ps_history_clear", ["powershell.exe"], _line("historysavepath", "consolehost_history.txt")),
    _process("ps_history_clear", ["powershell.exe"], _line("set-psreadlineoption"), _line("savenothing")),
    _process("sniffer_exec", ["tshark.exe", "windump.exe", "tcpdump.exe", "wprui.exe", "wpr.exe"]),
    _process("sniffer_exec", ["netsh.exe"], _line("trace")),
    _process("hh_abuse", ["hh.exe"]),
    _process("cred_search", None, _line("/f"), _line("password")),
    _process("cred_search", None, _line(*SEARCHES)),
    _process("cred_search", None, _line("reg"), _line("query"), _line("autologon", "defaultpassword")),
    _process("certutil_addstore", ["certutil.exe"], _line("-addstore")),
    _process("at_exec", ["at.exe"], ("CommandLine", "not is", [""])),
    _process("remote_schtask", ["schtasks.exe"], _line(" /s ", "/s\\\\")),
    _process("unc_execution", None, ("Path", "begins", ["\\\\"])),
    _process("regsvr32_child", None, ("Image", "not is", ["regsvr32.exe", "werfault.exe", "wevtutil.exe", "conhost.exe"]), parents=["regsvr32.exe"]),
    _process("share_cleanup", ["net.exe"], _line(" use"), _line(" /delete")),
    _process("share_cleanup", ["powershell.exe"], _line("remove-smbshare", "remove-fileshare")),
    _process("msbuild_abuse", ["msbuild.exe"], ("Path", "not has", ["\\microsoft visual studio\\", "\\msbuild\\"])),
    _process("msbuild_abuse", ["msxsl.exe"]),
    _process("cmstp_abuse", ["cmstp.exe"], _line("http", "\\\\")),
    (3, "lolbin_outbound", [OUT, ("Image", "is", OUTBOUND)]),
    (3, "ps_nonstandard", [OUT, ("Image", "is", ["powershell.exe", "cmd.exe"]), ("DestinationPort", "not is", ["80", "443", "8080", "8443", "53", "25", "587", "465"])]),
    (3, "internal_lateral", [OUT, ("Image", "is", [*HOSTS, "python.exe"]), ("DestinationIp", "begins", PRIVATE)]),
    (3, "rdp_nonstandard", [OUT, ("DestinationPort", "is", ["3389"]), ("Image", "not is", ["mstsc.exe", "msrdcw.exe"])]),
    (3, "smb_lateral", [OUT, ("DestinationPort", "is", ["445"]), ("Image", "is", [*HOSTS, "python.exe", "wmic.exe"])]),
    (3, "winrm_lateral", [OUT, ("DestinationPort", "is", ["5985", "5986"]), ("Image", "not is", ["wsmprovhost.exe", "winrm.cmd"])]),
    (3, "http_lolbin", [OUT, ("DestinationPort", "is", ["80", "443", "8080", "8443"]), ("Image", "is", HTTP_PROXIES)]),
    (3, "psexec_smb", [OUT, ("DestinationPort", "is", ["445"]), ("", "any", [("Image", "has", ["psexec", "paexec"]), ("Image", "is", ["sc.exe"])])]),
    (5, "tool_ended", [("Image", "is", TOOLS)]),
    (6, "vulnerable_driver", [("ImageLoaded", "has", DRIVERS)]),
    (6, "unsigned_driver", [UNSIGNED, ("ImageLoaded", "has", DRIVER_PATHS)]),
    (7, "known_library", [("ImageLoaded", "has", LIBRARIES)]),
    (7, "staged_library", [("ImageLoaded", "ends", [".dll", ".ocx"]), ("ImageLoaded", "has", STAGED_PATHS)]),
    (7, "unsigned_in_sensitive", [UNSIGNED, ("Image", "is", SENSITIVE)]),
    (7, "server_library", [("Image", "is", SERVERS), UNSIGNED, ("ImageLoaded", "not has", INSTALLED)]),
    (7, "registered_library", [("Image", "is", ["regsvr32.exe"]), ("Signed", "is", ["false"])]),
    (10, "credential_access", [("TargetImage", "is", ["lsass.exe"])]),
    (10, "sensitive_access", [("TargetImage", "is", TARGETS), ("", "any", [("GrantedAccess", "bits", [0x70]), ("GrantedAccess", "least", [0x1F0000])])]),
    (10, "handle_copy", [("TargetImage", "is", ["winlogon.exe", "services.exe"]), ("GrantedAccess", "bits", [0x40])]),
    (11, "scripted_file", [("Image", "is", WRITERS), ("", "any", [("TargetFilename", "has", WRITTEN_PATHS), ("TargetFilename", "ends", WRITTEN_ENDS)])]),
    (11, "memory_dump", [("TargetFilename", "ends", [".dmp", ".mdmp"])]),
    (11, "memory_dump", [("TargetFilename", "ends", [".bin"]), ("TargetFilename", "has", ["lsass", "ntds", "sam"])]),
    (11, "task_drop", [("TargetFilename", "has", ["\\windows\\system32\\tasks\\", "\\windows\\tasks\\"]), ("Image", "not is", ["svchost.exe", "taskeng.exe", "taskhostw.exe"])]),
    (11, "system_script", [("TargetFilename", "has", ["\\windows\\system32\\"]), ("TargetFilename", "ends", [".bat", ".cmd", ".ps1"])]),
    (11, "manager_dump", [("Image", "is", ["taskmgr.exe"]), ("TargetFilename", "has", ["lsass"]), ("TargetFilename", "ends", [".dmp"])]),
    (11, "directory_dump", [("TargetFilename", "has", ["ntds.dit", "ntds.jfm"])]),
    *[
        (k, name, tests)
        for k in (12, 13)
        for name, tests in [
            ("known_key", [("TargetObject", "has", REGISTRY)]),
            ("service_start", [("TargetObject", "has", ["\\services\\", "\\eventlog\\"]), ("TargetObject", "has", ["\\start"])]),
            ("service_path", [("TargetObject", "has", ["\\services\\"]), ("TargetObject", "has", ["imagepath"]), ("Details", "has", SERVICE_DETAILS)]),
            ("log_key", [("TargetObject", "has", ["\\eventlog\\"]), ("TargetObject", "ends", LOG_KEYS)]),
            ("server_key", [("TargetObject", "has", ["\\inprocserver32"]), ("TargetObject", "not has", ["\\windows\\system32\\"])]),
        ]
    ],
    (15, "alternate_stream", [("TargetFilename", "not ends", [":zone.identifier"])]),
    *[(k, "known_pipe", [("PipeName", "has", PIPES)]) for k in (17, 18)],
    *[(k, "scripted_pipe", [("Image", "is", [*SHELLS, "msbuild.exe"])]) for k in (17, 18)],
    (22, "scripted_query", [("Image", "is", RESOLVERS)]),
    (22, "long_query", [("QueryName", "longer", [60])]),
    (22, "long_label", [("QueryName", "label longer", [40])]),
    *[(k, "log_delete", [("", "any", [("TargetFilename", "has", ["\\winevt\\", "\\windows\\logs\\"]), ("TargetFilename", "ends", [".evtx"])])]) for k in (23, 26)],
    *[(k, "prefetch_delete", [("TargetFilename", "has", ["\\prefetch\\"]), ("TargetFilename", "ends", [".pf"])]) for k in (23, 26)],
    *[(k, "scripted_delete", [("Image", "is", SCRIPTED), ("TargetFilename", "ends", CLEANED)]) for k in (23, 26)],
]

# Tactics, and by rules in order of priority what an event does.
EXECUTION, CREDENTIALS, EVASION, DISCOVERY, LATERAL, PERSISTENCE, PRIVILEGE, COLLECTION = range(8)
TACTICS = [
    _process(LATERAL, None, ("Image", "not is", WMI_QUIET), parents=["wmiprvse.exe"]),
    _process(LATERAL, parents=["wsmprovhost.exe"]),
    _process(LATERAL, ["psexec.exe", "psexec64.exe", "psexesvc.exe", "paexec.exe"]),
    _process(LATERAL, ["schtasks.exe"], _line(" /s ", "/s\\\\")),
    _process(LATERAL, None, ("Path", "begins", ["\\\\"])),
    _process(LATERAL, SCRIPTED, parents=["mmc.exe", "dllhost.exe"]),
    _process(CREDENTIALS, DUMPERS),
    _process(CREDENTIALS, None, ("", "any", [("Image", "begins", ["procdump"]), ("Image", "is", ["rundll32.exe"])]), _line("lsass", "minidump")),
    _process(CREDENTIALS, ["reg.exe"], _line("save"), _line("sam", "security", "system", "ntds")),
    _process(CREDENTIALS, None, _line("sekurlsa::", "lsadump::", "kerberos::ptt", "kerberos::list", "token::elevate", "privilege::debug")),
    _process(CREDENTIALS, ["tshark.exe", "windump.exe", "tcpdump.exe"]),
    _process(PRIVILEGE, parents=ACCESSIBILITY),
    _process(PRIVILEGE, None, _line("echo"), _line(*PIPE_PATHS)),
    _process(PRIVILEGE, ["mavinject.exe"]),
    _process(PRIVILEGE, None, _line("/injectrunning")),
    _process(PRIVILEGE, None, _line("enablelua"), _line("/d 0")),
    _process(EVASION, ["fltmc.exe"], _line("unload")),
    _process(EVASION, ["powershell.exe"], _line("historysavepath", "set-psreadlineoption")),
    _process(EVASION, ["wevtutil.exe"], _line(" cl ", "clear-log")),
    _process(EVASION, ["taskkill.exe"], _line("msmpeng", "sysmon", "msseces", "winlogbeat")),
    _process(PERSISTENCE, ["schtasks.exe"], _line("/create"), ("CommandLine", "not has", [" /s "])),
    _process(PERSISTENCE, ["sc.exe"], _line("create")),
    _process(PERSISTENCE, ["bitsadmin.exe"], _line("/create", "/addfile")),
    _process(PERSISTENCE, ["at.exe"], ("CommandLine", "not is", [""])),
    _process(PERSISTENCE, parents=["w3wp.exe", "httpd.exe", "nginx.exe"]),
    _process(DISCOVERY, ENUMERATORS, ("ParentImage", "not is", SCRIPTED)),
    _process(DISCOVERY, ["net.exe"], _line(" user", " group", " localgroup", " view"), ("ParentImage", "not is", SCRIPTED)),
    _process(EXECUTION, ["wmic.exe"], _line("process"), _line("call")),
    _process(EXECUTION, HOSTS, parents=["winword.exe", "excel.exe", "powerpnt.exe", "outlook.exe", "onenote.exe", "eqnedt32.exe"]),
    (10, CREDENTIALS, [("TargetImage", "is", ["lsass.exe"])]),
    (24, COLLECTION, []),
    (2, EVASION, []),
    (25, EVASION, []),
    (28, EVASION, []),
]


def field(fields: Column, name: str) -> Column:
    """A field of an event's map<string,string>, as the rules read it."""
    raw = lambda n, default="": F.coalesce(F.try_element_at(fields, F.lit(n)), F.lit(default))
    if name in ("Image", "ParentImage", "TargetImage"):
        return F.lower(basename(raw(name)))
    if name == "Path":
        return F.lower(raw("Image"))
    if name == "DestinationPort":
        port = F.when(raw(name).rlike("^[+]?[0-9]{1,9}$"), F.regexp_replace(raw(name), "[+]", "").cast("int"))
        return F.when(port <= 65535, port.cast("string")).otherwise("0")
    if name == "Signed":
        return raw(name, "false")
    return F.lower(raw(name)) if name in LOWER else raw(name)


def hexadecimal(text: Column) -> Column:
    """The number of hexadecimal digits with or without 0x; 0 of anything else."""
    digits = F.regexp_replace(text, "^(0x)+", "")
    return F.when(digits.rlike("^[0-9a-fA-F]{1,15}$"), F.conv(digits, 16, 10).cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def test(fields: Column, name: str, kind: str, values: list) -> Column:
    if kind == "any":
        return reduce(lambda a, b: a | b, [test(fields, *t) for t in values])
    if kind == "all":
        return reduce(lambda a, b: a & b, [test(fields, *t) for t in values])
    if kind.startswith("not "):
        return ~test(fields, name, kind[4:], values)
    value = field(fields, name)
    if kind == "is":
        return value.isin(*values)
    if kind == "longer":
        return F.octet_length(value) > values[0]
    if kind == "label longer":
        return F.exists(F.split(value, "[.]"), lambda part: F.octet_length(part) > values[0])
    if kind == "bits":
        return hexadecimal(value).bitwiseAND(F.lit(values[0])) != 0
    if kind == "least":
        return hexadecimal(value) >= values[0]
    one = {"has": F.contains, "begins": F.startswith, "ends": F.endswith}[kind]
    return reduce(lambda a, b: a | b, [one(value, F.lit(v)) for v in values])


def meets(fields: Column, event: Column, kind: int, tests: list) -> Column:
    return reduce(lambda a, b: a & b, [test(fields, *t) for t in tests], event == kind)


def matches(fields: Column, event: Column, rules: list = RULES) -> Column:
    """Names of the rules that an event meets, each once, in the order of the rules.

    Only the rules of an event's own kind are evaluated.
    """
    out = F.array().cast("array<string>")
    for k in sorted({kind for kind, _, _ in rules}, reverse=True):
        found = [F.when(meets(fields, event, kind, tests), F.lit(name)) for kind, name, tests in rules if kind == k]
        out = F.when(event == k, F.array_distinct(F.array_compact(F.array(*found)))).otherwise(out)
    return out


def first_match(fields: Column, event: Column, rules: list, default: Column | None = None) -> Column:
    """The name of the first rule that an event meets: rule order is priority."""
    out = F.lit(None).cast("string") if default is None else default
    for kind, name, tests in reversed(rules):
        out = F.when(meets(fields, event, kind, tests), F.lit(name)).otherwise(out)
    return out


def is_attack(fields: Column, event: Column, rules: list = RULES) -> Column:
    """Whether an event counts by its kind or meets a rule."""
    return event.isin(*ALWAYS) | (F.size(matches(fields, event, rules)) > 0)


def tactic(fields: Column, event: Column, otherwise: Column | None = None) -> Column:
    """The number of the tactic that an event shows, by the first of TACTICS that it meets; else that of `otherwise`, or null."""
    return first_match(fields, event, TACTICS, F.lit(None).cast("int") if otherwise is None else otherwise)
