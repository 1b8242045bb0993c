"""Scalar functions of telemetry, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEVERITIES = ("low", "medium", "high", "critical")


def has_write_intent(flags: Column) -> Column:
    """Open mode 1 or 2, or the create bit."""
    return flags.bitwiseAND(3).isin(1, 2) | (flags.bitwiseAND(0o100) != 0)


def shannon_entropy(s: Column) -> Column:
    """Bits per character."""
    chars = F.filter(F.split(F.coalesce(s, F.lit("")), ""), lambda c: c != "")

    def over(cs: Column) -> Column:
        n = F.size(cs).cast("double")
        share = F.transform(F.array_distinct(cs), lambda c: F.size(F.filter(cs, lambda x: x == c)) / n)
        return F.aggregate(share, F.lit(0.0), lambda a, p: a - p * F.log2(p))

    return F.element_at(F.transform(F.array(chars), over), 1)


def normalise_image_path(p: Column) -> Column:
    """Windows paths in lower case, others as they are."""
    return F.when(F.rlike(p, F.lit(r"^([A-Za-z]:\\|\\\\)")), F.lower(p)).otherwise(p)


def normalise_domain(d: Column) -> Column:
    return F.regexp_replace(F.lower(d), r"\.$", "")


def dns_labels(d: Column) -> Column:
    return F.filter(F.split(d, r"\."), lambda x: x != "")


def dns_leftmost(d: Column) -> Column:
    """The first label of a name of three labels or more."""
    return F.when(F.size(dns_labels(d)) >= 3, F.get(dns_labels(d), F.lit(0)))


def dns_parent(d: Column) -> Column:
    """The last two labels of a name of three labels or more."""
    return F.when(F.size(dns_labels(d)) >= 3, F.array_join(F.slice(dns_labels(d), -2, 2), "."))


def base_technique(t: Column) -> Column:
    return F.substring_index(t, ".", 1)


def technique_id(tag: Column) -> Column:
    """attack.t1059.004 -> T1059.004; null for other tags."""
    found = F.regexp_extract(F.lower(tag), r"^attack\.(t[0-9]{4}(\.[0-9]{3})?)$", 1)
    return F.when(found != "", F.upper(found))


def split_techniques(t: Column) -> Column:
    return F.when(t.isin("BAYES", "Sigma"), F.array().cast("array<string>")).otherwise(F.split(t, "/"))


def severity_rank(s: Column) -> Column:
    out = F.lit(-1)
    for i, name in enumerate(SEVERITIES):
        out = F.when(s == name, i).otherwise(out)
    return out


def ip_class(addr: Column) -> Column:
    """unspecified, loopback, private, multicast, broadcast or public."""
    a = F.lower(addr)
    v4 = a.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$")
    part = lambda i: F.get(F.split(a, r"\."), F.lit(i)).try_cast("int")
    four = (
        F.when(a == "0.0.0.0", "unspecified")
        .when(part(0) == 127, "loopback")
        .when((part(0) == 10) | ((part(0) == 172) & part(1).between(16, 31)) | ((part(0) == 192) & (part(1) == 168)), "private")
        .when(a.endswith(".255"), "broadcast")
        .when(part(0) >= 224, "multicast")
        .otherwise("public")
    )
    six = F.when(a == "::", "unspecified").when(a == "::1", "loopback").when(a.rlike("^fe[89ab]"), "private").when(a.rlike("^f[cd]"), "private").when(a.rlike("^ff"), "multicast").otherwise("public")
    return F.when(a.isNull(), None).when(v4, four).otherwise(six)


#: Directories that hold software of the system.
TRUSTED = ("/usr/", "/bin/", "/sbin/", "/lib/", "/opt/", "/system/", "/applications/", "c:\\program files\\", "c:\\program files (x86)\\")
UNTRUSTED = ("c:\\windows\\temp\\", "c:\\windows\\tasks\\", "c:\\windows\\tracing\\")


def trusted_system_path(path: Column) -> Column:
    p = F.lower(path)
    hit = lambda names: F.array(*(F.startswith(p, F.lit(x)) for x in names))
    windows = F.startswith(p, F.lit("c:\\windows\\")) & ~F.exists(hit(UNTRUSTED), lambda x: x)
    return F.when(path.isNull(), True).otherwise(windows | F.exists(hit(TRUSTED), lambda x: x))


#: Child -> parents that it is usually started by.
PARENTS = {"lsass.exe": ("wininit.exe",), "services.exe": ("wininit.exe",), "svchost.exe": ("services.exe", "svchost.exe"), "winlogon.exe": ("smss.exe",), "taskhostw.exe": ("svchost.exe",), "runtimebroker.exe": ("svchost.exe",), "wermgr.exe": ("svchost.exe",)}


def expected_parent(child: Column, parent: Column) -> Column:
    out = F.lit(True)
    for name, parents in PARENTS.items():
        out = F.when(F.lower(child) == name, F.lower(parent).isin(*parents)).otherwise(out)
    return F.when(parent.isNull(), True).otherwise(out)


def ml_cmdline(argv: Column, cmdline: Column) -> Column:
    """Arguments, each closed by NUL; the command line where there are none."""
    return F.when(F.size(argv) > 0, F.concat(F.array_join(argv, "\0"), F.lit("\0"))).otherwise(cmdline)


def url_normalise(u: Column) -> Column:
    """Percent-decoded twice (bad escapes stay), lower case, comments and runs of blanks as one space."""
    once = lambda x: F.url_decode(F.regexp_replace(x, r"%(?![0-9A-Fa-f]{2})", "%25"))
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(once(once(u))), r"/\*\*/", " "), r"(?U)\s+", " "))


def target_path(u: Column) -> Column:
    return F.substring_index(u, "?", 1)


def target_params(u: Column) -> Column:
    """(name, value) of each query parameter."""
    query = F.when(F.instr(u, "?") > 0, F.substring(u, F.instr(u, "?") + 1, F.length(u))).otherwise("")
    parts = F.filter(F.split(query, "&"), lambda x: x != "")
    value = lambda x: F.when(F.instr(x, "=") > 0, F.substring(x, F.instr(x, "=") + 1, F.length(x))).otherwise("")
    return F.transform(parts, lambda x: F.struct(F.substring_index(x, "=", 1).alias("name"), value(x).alias("value")))


def appended_suffix(old: Column, new: Column) -> Column:
    """What a rename added: the rest after the old path, else after the old base name; null if nothing."""
    base = F.substring_index(old, "/", -1)
    name = F.substring_index(new, "/", -1)
    rest = F.when(F.startswith(new, old), F.substring(new, F.length(old) + 1, F.length(new))).when(F.startswith(name, base), F.substring(name, F.length(base) + 1, F.length(name)))
    return F.when(rest != "", rest)


#: Fixed values: (pattern, replacement) in order, for texts of connections, lines typed into a shell, and names that are looked up.
REDACTIONS = {
    "tls": [
        (r"(?i)authorization:\s*[^\r\n]+", "Authorization: [REDACTED]"),
        (r"(?i)cookie:\s*[^\r\n]+", "Cookie: [REDACTED]"),
        (r"(https?://)([^:@\s]+):([^@\s]+)@", "$1[REDACTED]:[REDACTED]@"),
        (r"[?&](api_key|token|key|apikey|access_token)=[^&\s]+", "?$1=[REDACTED]"),
    ],
    "shell": [
        (r"""(?i)\b(export\s+\w+)=(['"]?)([^'"\s]+)(['"]?)""", "$1=[REDACTED]"),
        (r"""(?i)--password[=\s]+(['"]?)([^'"\s]+)(['"]?)""", "--password=[REDACTED]"),
        (r"""(?i)(^|[^-])-p\s*(['"]?)([^'"\s]+)(['"]?)""", "$1-p[REDACTED]"),
        (r"(?i)(aws_secret_access_key|aws_session_token)=([^\s]+)", "$1=[REDACTED]"),
        (r"""-u\s+(['"]?)([^'"\s]+)(['"]?)""", "-u [REDACTED]"),
    ],
    "dns": [(r"(?i)^.+\.(local|internal|lan|home|corp|intranet)\.?$", "[REDACTED].$1")],
}


def redact(text: Column, kind: str) -> Column:
    """A text without what its kind (tls, shell, dns) calls sensitive."""
    for pattern, by in REDACTIONS[kind]:
        text = F.regexp_replace(text, f"(?U){pattern}", by)
    return text


def pseudonym(host: Column) -> Column:
    return F.substring(F.sha2(host, 256), 1, 12)


def truncated(text: Column, most: int = 200) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(" [truncated]"))).otherwise(text)


#: Fixed values.
PACKAGE_SUFFIXES, STAGING, PACKAGE_COMMS = (".dpkg-new", ".apk-new"), ".apk.", ("dpkg", "dpkg-deb", "apt", "apt-get", "apk")


def rename_spared(old: Column, new: Column, comm: Column, trusted: Column) -> Column:
    """Renames that are routine: suffixes without letters, trusted edits in place, mail flags and deliveries, package managers."""
    suffix = appended_suffix(old, new)
    base = lambda p: F.substring_index(p, "/", -1)
    flagless = lambda p: F.regexp_replace(base(p), r":2,[DFPRST]*$", "")
    mail = new.rlike(r":2,[DFPRST]*$") & (flagless(old) == flagless(new))
    delivery = old.rlike("/tmp/[^/]+$") & new.rlike("/(new|cur)/[^/]+$") & (flagless(old) == flagless(new))
    package = comm.isin(*PACKAGE_COMMS) & (F.endswith(old, F.lit(PACKAGE_SUFFIXES[0])) | F.endswith(old, F.lit(PACKAGE_SUFFIXES[1])) | F.startswith(base(old), F.lit(STAGING)))
    return F.coalesce(suffix.isNotNull() & ~suffix.rlike("[A-Za-z]"), F.lit(False)) | ((comm == "sed") & trusted) | mail | delivery | package


#: What of an event is shown as evidence.
EVIDENCE = ("type", "image_path", "cmdline", "daddr", "path")


def evidence(event: Column) -> Column:
    """The listed fields of an event's JSON, where they are text; long command lines are cut; none: null."""
    field = lambda f: F.get_json_object(event, f"$.{f}")
    shown = F.struct(*((truncated(field(f)) if f == "cmdline" else field(f)).alias(f) for f in EVIDENCE))
    return F.when(F.coalesce(*(field(f) for f in EVIDENCE)).isNotNull(), F.to_json(shown))
