"""Rules on mail addresses and hosts as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: functional mailbox names; these also occur in people's names, so dots don't delimit them
ROLE_WORDS = (
    "info contact kontakt hello hallo office mail email team admin administrator webmaster postmaster hostmaster root system "
    "sales vertrieb marketing news presse press support service help helpdesk feedback kundenservice "
    "billing accounts accounting buchhaltung rechnung rechnungen finance hr jobs job career careers karriere bewerbung recruiting "
    "datenschutz privacy legal compliance abuse security auto empfang sekretariat reception anfrage anfragen"
).split()
# fixed values: names of machines, as a token between any delimiters
AUTOMATION_TOKENS = "noreply donotreply mailerdaemon bounce bounces notifications notification notify automated daemon mailer delivery newsletter".split()
# fixed values: the same spread over several tokens
AUTOMATION_PHRASES = ("no reply", "do not reply", "mailer daemon")
# fixed values: machine senders for the automation flags
MACHINE_TOKENS = "noreply donotreply mailerdaemon postmaster bounce bounces".split()
# fixed values: providers of personal mailboxes
GENERIC_DOMAINS = (
    "gmail.com googlemail.com outlook.com outlook.de hotmail.com hotmail.de hotmail.co.uk live.com live.de msn.com "
    "yahoo.com yahoo.de yahoo.co.uk ymail.com rocketmail.com icloud.com me.com mac.com aol.com aol.de proton.me protonmail.com pm.me "
    "gmx.de gmx.net gmx.com gmx.at gmx.ch web.de t-online.de freenet.de arcor.de online.de mail.com email.com mail.ru yandex.com yandex.ru "
    "zoho.com fastmail.com hey.com posteo.de mailbox.org tutanota.com bluewin.ch sunrise.ch hispeed.ch gmx.li a1.net aon.at chello.at magenta.at kabsi.at "
    "abv.bg mail.bg dir.bg inbox.bg gbg.bg mail.orbitel.bg"
).split()
# fixed values: suffixes below which every label is an organisation of its own. The three of mail and
# wiki hosting are required; the rest is a small set of public multi-label suffixes, no full list is at hand.
SUFFIXES = (
    "atlassian.net onmicrosoft.com mail.onmicrosoft.com "
    "co.uk org.uk ac.uk gov.uk me.uk ltd.uk plc.uk net.uk com.au net.au org.au edu.au gov.au co.nz org.nz net.nz "
    "co.at or.at ac.at gv.at com.br net.br org.br co.jp ne.jp or.jp ac.jp co.in net.in org.in co.za org.za com.tr com.mx com.ar com.cn com.hk com.sg com.tw com.pl com.ua co.il co.kr "
    "github.io gitlab.io blogspot.com herokuapp.com netlify.app vercel.app web.app pages.dev azurewebsites.net"
).split()

#: White space as strip() takes it, in Java's expressions.
EDGE = r"(?U)^\s+|\s+$"


def strip(x: Column) -> Column:
    return F.regexp_replace(x, EDGE, "")


def in_words(x: Column, words: list[str]) -> Column:
    return x.isin(*words)


def normalize_email(x: Column) -> Column:
    """Trimmed, without angle brackets around, trimmed, lower case. Dots and plus parts stay."""
    return F.lower(strip(F.regexp_replace(strip(x), r"^[<>]+|[<>]+$", "")))


def local_part(x: Column) -> Column:
    """Before the last @; null without one."""
    return F.when(F.contains(x, F.lit("@")), F.regexp_replace(x, "@[^@]*$", ""))


def domain(x: Column) -> Column:
    """After the last @; null without one or if empty."""
    return F.nullif(F.when(F.contains(x, F.lit("@")), F.element_at(F.split(x, "@"), -1)), F.lit(""))


def _tokens(local: Column, delimiters: str) -> Column:
    return F.filter(F.split(local, delimiters), lambda t: t != "")


def _has_phrase(local: Column) -> Column:
    spaced = F.concat(F.lit(" "), F.array_join(_tokens(local, "[-_.+]"), " "), F.lit(" "))
    found = F.lit(False)
    for phrase in AUTOMATION_PHRASES:
        found = found | F.contains(spaced, F.lit(f" {phrase} "))
    return found


def is_role(address: Column) -> Column:
    """A functional mailbox: its local part, a token of it between - _ +, or for machine names between any
    of - _ . + is such a word, or the tokens hold a machine phrase. Without @ it is none."""
    local = F.lower(local_part(address))
    any_of = lambda words: F.array(*map(F.lit, words))
    found = in_words(local, ROLE_WORDS + AUTOMATION_TOKENS) | F.arrays_overlap(_tokens(local, "[-_.+]"), any_of(AUTOMATION_TOKENS)) | F.arrays_overlap(_tokens(local, "[-_+]"), any_of(ROLE_WORDS)) | _has_phrase(local)
    return F.coalesce(found, F.lit(False))


def is_machine(address: Column) -> Column:
    """A sender that is a machine by its address."""
    local = F.lower(F.coalesce(local_part(address), address))
    return F.coalesce(F.arrays_overlap(_tokens(local, "[-_.+]"), F.array(*map(F.lit, MACHINE_TOKENS))) | _has_phrase(local), F.lit(False))


def is_generic(host: Column) -> Column:
    return in_words(F.lower(host), GENERIC_DOMAINS)


def is_punycode(host: Column) -> Column:
    return F.exists(F.split(F.lower(host), r"\."), lambda label: label.startswith("xn--"))


def is_suspicious_idn(host: Column) -> Column:
    return is_punycode(host) | host.rlike(r"[^\x00-\x7F]")


def registrable(host: Column) -> Column:
    """The longest known suffix and one label more; hosts that don't fold stay as they are."""
    labels = F.split(F.lower(host), r"\.")
    known = F.array(*map(F.lit, SUFFIXES))
    tail = lambda n: F.when(F.size(labels) >= n, F.array_join(F.slice(labels, F.size(labels) - n + 1, F.lit(n)), "."))
    kept = F.when(F.array_contains(known, tail(3)), tail(4)).when(F.array_contains(known, tail(2)), tail(3)).otherwise(tail(2))
    whole = F.lower(host)
    return F.when(whole.rlike(r"^\d+(\.\d+)*$") | ~F.contains(whole, F.lit(".")) | whole.rlike(r"^\.|\.\.|\.$"), whole).otherwise(F.coalesce(kept, whole))


def clean_name(x: Column) -> Column:
    """Trimmed, one matching pair of quotes around it removed, trimmed; null if nothing is left."""
    t = strip(x)
    quoted = t.rlike(r"(?s)^'.+'$") | t.rlike(r'(?s)^".+"$')
    return F.nullif(strip(F.when(quoted, F.substring(t, 2, F.length(t) - 2)).otherwise(t)), F.lit(""))


def is_internal(address: Column, mailbox: Column, folded: Column | None = None, own: Column | None = None) -> Column:
    """Of the mailbox's company; for a mailbox at a personal provider, the very address. ``folded`` and ``own``: what the
    hosts of both fold to, if that is known."""
    host = domain(normalize_email(mailbox))
    own = registrable(host) if own is None else own
    folded = registrable(domain(normalize_email(address))) if folded is None else folded
    company = F.when(~is_generic(host) & ~is_generic(own), own)
    return F.coalesce(F.when(company.isNotNull(), folded == company).otherwise(normalize_email(address) == normalize_email(mailbox)), F.lit(False))


def within_one_edit(a: Column, b: Column) -> Column:
    """At most one substitution, insertion or deletion; equal strings are within."""
    return F.levenshtein(a, b, 1) >= 0


def mailbox_root(local: Column) -> Column:
    """Without the part after + and without dots."""
    return F.replace(F.substring_index(local, "+", 1), F.lit("."), F.lit(""))


def is_malformed(host: Column) -> Column:
    return ~F.contains(host, F.lit(".")) | host.rlike(r"[\[_ ]") | host.endswith(".")


def direction(sender: Column, mailbox: Column) -> Column:
    """outbound from the mailbox itself, else inbound; null where either is unknown."""
    a, b = F.lower(strip(sender)), F.lower(strip(mailbox))
    return F.when(F.nullif(a, F.lit("")).isNull() | F.nullif(b, F.lit("")).isNull(), None).when(a == b, "outbound").otherwise("inbound")
