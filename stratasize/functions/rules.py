"""The classification rule pack as data, and its compilation to Spark predicates."""

from __future__ import annotations

import re
import re._parser as re_parser
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values, in table order: priority, name, category, subcategory; literal parts of the machine's name; then patterns
# of the name, of the OS and of the folder; whether name patterns may match the description as well.
RULES: list[tuple[int, str, str, str, tuple[str, ...], tuple[str, ...], tuple[str, ...], tuple[str, ...], bool]] = [
    (88, "Oracle HCC + TDE", "Database", "Oracle - HCC + TDE", (), ("(?=.*(?:ORACLE|ORA))(?=.*HCC)(?=.*TDE)",), (), (), False),
    (89, "Oracle HCC", "Database", "Oracle - HCC (App Compressed)", (), (r"(?=.*(?:ORACLE|ORA))(?=.*\bHCC\b)",), (), (), False),
    (90, "Oracle TDE", "Database", "Oracle - TDE (Encrypted)", ("ORACLE-TDE", "ORA-TDE", "ORATDE", "ORACLE-ENC", "ORA-ENC"), (), (), (), False),
    (91, "SQL Page Compressed + TDE", "Database", "Microsoft SQL - Page Compressed + TDE", (), ("(?=.*(?:MSSQL|SQL))(?=.*(?:COMPRESS|PAGE))(?=.*TDE)",), (), (), False),
    (92, "SQL Page Compressed", "Database", "Microsoft SQL - Page Compressed", ("SQL-COMPRESS", "SQL-COMP", "SQL-PAGE", "MSSQL-COMPRESS", "MSSQL-PAGE", "DWH"), (), (), (), False),
    (93, "SQL TDE", "Database", "Microsoft SQL - TDE (Encrypted)", ("SQL-TDE", "MSSQL-TDE", "SQL-ENC", "MSSQL-ENC"), (), (), (), False),
    (94, "MongoDB Encrypted", "Database", "MongoDB - Encrypted", ("MONGO-ENC", "MONGO-ENCRYPT", "MONGODB-ENC"), (), (), (), False),
    (95, "PostgreSQL Encrypted", "Database", "PostgreSQL - Encrypted", ("PGSQL-ENC", "POSTGRES-ENC", "PG-ENC", "POSTGRESQL-ENC"), (), (), (), False),
    (96, "MySQL / NoSQL Encrypted", "Database", "My SQL / NoSQL - Encrypted", ("MYSQL-ENC", "MYSQL-ENCRYPT", "NOSQL-ENC", "MARIADB-ENC"), (), (), (), False),
    (97, "Kubernetes Encrypted PVs", "Containers", "Kubernetes - Encrypted PVs", ("K8S-ENC", "K8S-LUKS", "KUBE-ENC", "KUBE-LUKS", "K8S-ENCRYPT"), (), (), (), False),
    (100, "Oracle Database", "Database", "Oracle", ("ORACLE",), (), (), (), False),
    (101, "MySQL / NoSQL", "Database", "My SQL / NoSQL", ("MYSQL", "NOSQL", "MARIADB", "FILEMAKER", "CLARIS", "SQLITE", "REDIS"), (), (), (), False),
    (102, "PostgreSQL", "Database", "PostgreSQL", ("PGSQL", "POSTGRES", "POSTGRESQL", "INSIGHTIQ"), (), (), (), False),
    (103, "Microsoft SQL", "Database", "Microsoft SQL", ("SQL", "MSSQL", "SECDB"), (), (), (), False),
    (104, "DB2", "Database", "DB2", (), (r"\bDB2\b",), (), (), False),
    (105, "MongoDB", "Database", "MongoDB", ("MONGODB", "MONGO"), (), (), (), False),
    (106, "Prometheus", "Database", "Prometheus", ("PROMETHEUS",), (), (), (), False),
    (107, "SAP HANA", "Database", "SAP HANA(S4)", ("HANA", "S4HANA"), (r"S4[A-Z]\d",), (), (), False),
    (108, "SAP Traditional", "Database", "SAP Traditional (R/3 / ECC)", ("SAP-", "SAP_"), (r"\bSAP\b", "^SAP(?![a-z])", "^SAP(?:ERP|NWG|BOBI|BODS|BPC|ADS|CCM|SOM|CUA|BCOM|ENOW|COCKPIT|LICENSE|FRONT)"), (), (), False),
    (109, "SAP HANA HDB", "Database", "SAP HANA(S4)", ("SAPHDB",), (r"\bHDB\d+\b",), (), ("HanaDB|HANA[-_ ]?DB",), False),
    (175, "SAP general (folder)", "Database", "SAP Traditional (R/3 / ECC)", (), (), (), ("/SAP[_ -]|/SAP$",), False),
    (200, "HealthCare EMR/EHR", "HealthCare", "EMR/EHR (Epic, McKesson)", ("EPIC", "MCKESSON", "EMR", "EHR", "PACS", "INTELLISPACE", "GLEAMER", "AZMED", "RAYVOLVE", "TRAUMACAD", "OPALE", "CARIATIDE", "HANDYLIFE", "POLYPOINT", "PLAISIR", "MEDIDATA", "DATABICS", "PROCAMED", "SEDIA", "DGLAB", "DGLIM", "STERIGEST", "WINSCRIBE", "SYNLAB", "EXOLIS", "SCENARA", "MIRTH", "KODIP", "CARDIO", "ORAMED", "EMEDISTA", "EASYDOSE", "CODMED", "DCIMED", "HEMA"), (r"\bRIS\b", r"\bSIEMS\b", r"\bHESTIA\b", "Bloc-?Op|BLOCOP"), (), (), False),
    (215, "Microsoft Exchange (folder)", "Email", "Domino/Notes, Exchange, Sendmail, Zimbra, etc", (), (), (), ("/EXCH(?:ANGE)?(?:/|$)",), False),
    (250, "Cisco Unified Communications", "Web Servers", "Content included", ("Cisco Unity Connection",), (r"\b(?:CUCM|UCCX|CUIC|FINESSE|IPCC|CCX|CUIM|CUC|CER|PCD)\b",), (), ("/UC(?:M)?(?:/|$)",), True),
    (210, "Email", "Email", "Domino/Notes, Exchange, Sendmail, Zimbra, etc", ("EXCHANGE", "DOMINO", "ZIMBRA", "SENDMAIL", "MSG", "EXCHG", "EXCH"), (r"[-_]EX\d", r"EXC\d", r"\bMAIL\b"), (), (), False),
    (220, "VDI Full Clone / MCS", "VDI", "Full Clone / MCS (Citrix)", ("CITRIX", "CIT", "MCS"), (), (), (), False),
    (221, "VDI Linked Clone / PVS", "VDI", "Linked Clone / PVS (Citrix)", ("PVS", "CP-REPLICA", "CP-TEMPLATE", "MST-W10"), (), (), (), False),
    (222, "VDI Instant Clone", "VDI", "Instant Clone", ("HORIZON",), (), (), (), False),
    (223, "VDI Profiles", "VDI", "VDI Profiles", ("APPVOL", "APP VOLUMES", "APP-VOL"), ("VDI.*PROFIL|PROFIL.*VDI",), (), (), False),
    (224, "VDI Generic", "VDI", "Linked Clone / PVS (Citrix)", ("VDI", "DESKTOP", "LOGINVSI", "LOGINENTERPRISE", "UAG", "RDS"), (), (), (), False),
    (294, "Nutanix CVM", "VM Replication", "Data Domain Virtual Edition (DDVE)", ("NTNX-", "NTNX_", "Nutanix Controller VM"), ("[-_]CVM(?:[-_]|$)",), (), ("/NTNX[ _-]?CVMs?(?:/|$)",), True),
    (293, "DDVE", "VM Replication", "Data Domain Virtual Edition (DDVE)", ("DDVE", "DATADOMAIN", "DATA-DOMAIN"), (), (), (), False),
    (295, "Veeam Compressed + Dedup", "VM Replication", "Veeam - Compressed + Dedup", ("VEEAM-DD", "VBR-DD"), (), (), (), False),
    (296, "Commvault Compressed + Dedup", "VM Replication", "Commvault - Compressed + Dedup", ("COMMVAULT-DD", "CVD-DD"), (), (), (), False),
    (297, "Commvault", "VM Replication", "Commvault", ("COMMVAULT", "CVD"), (), (), (), False),
    (298, "Veritas / NetBackup", "VM Replication", "Veeam, Zerto, RP4VM", ("VERITAS", "NETBACKUP", "NBU"), (), (), (), False),
    (299, "Dell PowerProtect (description)", "VM Replication", "Veeam, Zerto, RP4VM", ("PowerProtect",), (), (), (), True),
    (300, "VM Replication", "VM Replication", "Veeam, Zerto, RP4VM", ("VEEAM", "VBR", "ZERTO", "RP4VM"), (), (), (), False),
    (311, "Dell PowerFlex SDS", "Containers", "Kubernetes, OpenShift, Docker, Tanzu, etc", (), (r"\bpflex\w*",), (), ("/PowerFlex(?:/|$)",), False),
    (320, "Domain Controller / AAD", "Virtual Machines", "VMware / Hyper-V / KVM - No Database, File nor Email", (), (r"\bDC\d+\b", r"\bAADC?\d*\b", r"\bADDS\b", r"\b(?:INFRA|JUS|INFRAPOL|EXPLOIT)DC\b"), (), ("/AD$|/AADC|/Domain Controllers",), False),
    (325, "IPAM", "Web Servers", "Content included", (), (r"\bIPAM\b", r"\bphpipam\b"), (), ("/IPAM(?:/|$)",), False),
    (330, "Identity / Auth (Nevis)", "Web Servers", "Content included", (), (r"\bnevis\b",), (), ("/IAM|/EID|/NEVIS",), False),
    (310, "Containers", "Containers", "Kubernetes, OpenShift, Docker, Tanzu, etc", ("DOCKER", "KUBERNETES", "K8S", "OPENSHIFT", "TANZU", "TKG", "HARBOR"), ("photon-.*-kube", r"^worker\d", r"^master\d", r"^bootstrap\b"), (), (), False),
    (315, "WSUS", "Web Servers", "Content included", ("WSUS",), (), (), (), False),
    (320, "Web Servers", "Web Servers", "Content included", ("WEB", "WWW", "APACHE", "NGINX", "IIS", "TOMCAT", "FORTIWEB", "INTRANET"), (), (), (), False),
    (330, "File General Purpose", "File", "General Purpose", ("FILE",), (r"^FS\d", "^FS[-_]", r"DFS\d", "DFS[-_]"), (), (), False),
    (340, "File Content Servers", "File", "Content Servers (Git, Sharepoint)", ("GIT", "GITLAB", "BITBUCKET", "SHAREPOINT", "ALFRESCO", "SPBE", "SPFE", "SPOWA", "SPOFFICE", "SPAPP", "SPWFE", "KENDOX", "AUTOSTORE", "AUSTORE", "YOUDOC", "OTRECM", "DOCPRO"), ("^ECM",), (), (), False),
    (350, "File Developer Workspaces", "File", "Developer Workspaces (DevOps)", ("DEVOPS", "JENKINS", "ANSIBLE", "DEPLOY", "ARTIFACT", "CICD"), (), (), (), False),
    (360, "File Archive", "File", "Archive / Backup / Compressed / Encrypted / Rich Media / ISO / PACS / CAD", ("ARCHIVE", "BACKUP", "MAILARCH", "VIDEOMGMT"), (), (), (), False),
    (395, "VMware Infrastructure VMs", "Virtual Machines", "VMware / Hyper-V / KVM - No Database, File nor Email", ("VCLS", "VXRAIL"), (), (), (), False),
    (396, "vCenter / vSAN Witness (description)", "Virtual Machines", "VMware / Hyper-V / KVM - No Database, File nor Email", ("vCenter Server Appliance", "vSAN Witness"), (), (), (), True),
    (397, "Application servers (identified)", "Virtual Machines", "VMware / Hyper-V / KVM - No Database, File nor Email", ("ABACUS", "MIDPOINT", "METADIR", "MESSERLI", "TALEND", "EYEGLASS"), (), (), (), False),
    (401, "FortiDeceptor (description)", "Logging - Analytics", "FortiNet, Elastic Search, Splunk, ELK, etc", ("FortiDeceptor",), (), (), (), True),
    (430, "BeyondTrust / Bomgar (description)", "Web Servers", "Content included", ("BeyondTrust", "Bomgar"), (), (), (), True),
    (435, "Tenable Nessus (description)", "Web Servers", "Content included", ("Tenable", "Nessus"), (), (), (), True),
    (450, "NetApp OnCommand UM (description)", "Web Servers", "Content included", ("OnCommand Unified Manager",), (), (), (), True),
    (460, "Horizon3.ai NodeZero (description)", "Web Servers", "Content included", ("Horizon3.ai", "Nodezero"), (), (), (), True),
    (465, "exotrack (description)", "Web Servers", "Content included", ("exotrack",), (), (), (), True),
    (400, "Logging Analytics", "Logging - Analytics", "FortiNet, Elastic Search, Splunk, ELK, etc", ("ELASTIC", "ELK", "SPLUNK", "FORTIANALYZER", "FORTIMANAGER", "FORTIADC", "FAZ", "FMG", "ZABBIX", "CENTREON", "OBSERVIUM", "GRAFANA", "RSYSLOG", "SYSLOG", "POLLER", "PRTG", "LOGSTASH", "KIBANA", "LOGINSIGHT", "NAGIOS", "ICINGA", "SOLARWINDS", "LIBRENMS", "OPENNMS", "LOGDMZ"), (r"LOG(?:\d|[-_.]|$)", r"FORTIA\d", "^MONITOR"), ("FORTI",), (), False),
    (500, "Boot from SAN", "Boot from SAN", "Linux, VMware, Windows - OS Boot", ("BOOTSAN", "SANBOOT"), (), (), (), False),
    (900, "Windows Server (OS fallback)", "Virtual Machines", "VMware / Hyper-V / KVM - No Database, File nor Email", (), (), ("windows server",), (), False),
    (905, "Windows Desktop (OS fallback)", "VDI", "Linked Clone / PVS (Citrix)", (), (), ("windows 10|windows 11|windows 7",), (), False),
    (910, "Linux (OS fallback)", "Virtual Machines", "VMware / Hyper-V / KVM - No Database, File nor Email", (), (), ("linux|ubuntu|centos|debian|red hat|suse|alma|rocky|oracle linux|freebsd|solaris",), (), False),
    (920, "VMware/ESXi (OS fallback)", "Virtual Machines", "VMware / Hyper-V / KVM - No Database, File nor Email", (), (), ("vmware|esxi|photon",), (), False),
    (999, "default", "Unknown (Reducible)", "Unknown (Reducible)", (), (".*",), (), (), False),
]

#: Role prefixes that hide a name's application (fixed value).
ROLE_PREFIX = r"^(?:SRV|PC)[-_.]?"
#: Below this priority a rule names an application; from it on, it falls back to the OS or to nothing.
FALLBACK_PRIORITY, LAST_OS_PRIORITY = 900, 998
#: Case-insensitive, with Unicode case and classes.
FLAGS = "(?iuU)"
#: Letters that match an ASCII letter in any case but aren't lower-cased to it.
_ODD, _PLAIN = "ſıİK", "siik"


def folded(text: Column) -> Column:
    """A text in which what matches an ASCII letter in any case is that letter in lower case."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.lower(F.translate(text, _ODD, _PLAIN)))


@dataclass(frozen=True)
class Rule:
    """Patterns of a set are alternatives; mode "any" needs one set to match, "all" every set that has patterns."""

    name: str
    category: str
    subcategory: str
    priority: int
    names: tuple[str, ...] = ()
    systems: tuple[str, ...] = ()
    folders: tuple[str, ...] = ()
    mode: str = "any"
    description: bool = False

    def matches(self, name: Column, system: Column, folder: Column, description: Column | None = None, low: Sequence[Column | None] = (None,) * 4) -> Column:
        """Whether the rule matches; columns must not be null. low: the columns folded(), in which literals that a pattern
        needs are looked for before the pattern is tried."""
        found = []
        if self.names:
            hit = _holds(self.names, name, low[0])
            if self.description and description is not None:
                hit = hit | ((description != "") & _holds(self.names, description, low[3]))
            found.append(hit)
        if self.systems:
            found.append(_holds(self.systems, system, low[1]))
        if self.folders:
            found.append(_holds(self.folders, folder, low[2]))
        out = F.lit(False) if not found else found[0]
        for hit in found[1:]:
            out = (out & hit) if self.mode == "all" else (out | hit)
        return out

    @property
    def confidence(self) -> str:
        return "rule_match" if self.priority < FALLBACK_PRIORITY else "os_fallback" if self.priority <= LAST_OS_PRIORITY else "default"


def _any(patterns: Sequence[str]) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def _holds(patterns: Sequence[str], text: Column, low: Column | None) -> Column:
    """Whether a pattern matches the text: a few searches for plain literals spare most texts the patterns."""
    hit, needed = text.rlike(FLAGS + _any(patterns)), None if low is None else needed_literals(patterns)
    return hit if needed is None else reduce(lambda a, b: a | b, [low.contains(x) for x in needed]) & hit


def _quoted(literal: str) -> str:
    return re.sub(r"([^\w\s])", r"\\\1", literal)


def default_rules() -> list[Rule]:
    """The whole pack in order of priority, ties in table order."""
    out = [
        Rule(name, category, subcategory, priority, (*map(_quoted, literals), *names), systems, folders, description=description)
        for priority, name, category, subcategory, literals, names, systems, folders, description in RULES
    ]
    return sorted(out, key=lambda r: r.priority)


def override_rules() -> list[Rule]:
    """The rules that name an application."""
    return [r for r in default_rules() if r.priority < FALLBACK_PRIORITY]


def required_literals(pattern: str) -> set[str] | None:
    """Lower-case texts of which every match of a pattern, in any case, holds one; None if there are none to be told."""
    try:
        return _required(re_parser.parse(pattern, re.IGNORECASE))
    except (re.error, RecursionError):
        return None


def needed_literals(patterns: Sequence[str]) -> list[str] | None:
    """Literals of which every match of any pattern holds one, less those that hold another; None if there are none."""
    sets = [required_literals(p) for p in patterns]
    if None in sets:
        return None
    every = set().union(*sets)
    return sorted(x for x in every if not any(y != x and y in x for y in every))


def _required(parsed) -> set[str] | None:
    """The best set that any item of a sequence needs: the one whose shortest text is longest."""
    found, run = [], ""
    for kind, value in [*parsed, (None, None)]:
        if kind is re_parser.LITERAL:
            run += chr(value)
            continue
        if run:
            found.append({run.lower()})
        run, inner = "", None
        if kind is re_parser.SUBPATTERN:
            inner = _required(value[-1])
        elif kind is re_parser.BRANCH:
            parts = [_required(p) for p in value[1]]
            inner = None if None in parts else set().union(*parts)
        elif kind in (re_parser.MAX_REPEAT, re_parser.MIN_REPEAT) and value[0] > 0:
            inner = _required(value[2])
        elif kind is re_parser.ASSERT and value[0] > 0:
            inner = _required(value[1])
        if inner:
            found.append(inner)
    return max(found, key=lambda f: (min(map(len, f)), -len(f)), default=None)
