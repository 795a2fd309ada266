"""The detection rules, in order of priority, as data.

A rule finds ``before``, then its value, then ``after``; the span is the value.  ``words``, ``folded``, ``digit`` and
``trigger`` are cheap tests of the whole text that any match implies, so that most texts skip the expensive pattern.
"""

from __future__ import annotations

from dataclasses import dataclass

from maskwork.functions import validators as V

# Word characters are ASCII here, whatever the regex engine thinks of accents.
W = "[0-9A-Za-z_]"
EDGE = f"(?:(?<!{W})(?={W})|(?<={W})(?!{W}))"
SPACE = r"[\s\x{00A0}]"


@dataclass(frozen=True)
class Rule:
    label: str
    category: str
    value: str
    before: str = ""
    after: str = ""
    trigger: str = ""  # a regex
    ignore_case: bool = False
    check: V.Validator | None = None
    extend: bool = False
    score: float = 1.0
    rank: int = 0
    #: Capturing groups inside ``before`` and inside ``value``.
    groups: int = 0
    value_groups: int = 0
    #: Whether the check looks at the text around the value.
    context: bool = False
    words: tuple[str, ...] = ()  # any of which has to be there
    folded: tuple[str, ...] = ()  # any of which has to be there in lower case
    digit: bool = False  # whether a digit has to be there


def plain(check) -> V.Validator:
    return lambda value, match: check(value)


# Repeats are possessive (``*+``) or bounded where what follows could otherwise be tried in many ways: the engine recurses on
# repeated groups, and tries all cuts of a long run of spaces between two repeats of them.
# The shared parts of the patterns.
ID_LABEL = rf"{SPACE}*+(?:no\.?|num(?:ber)?|#)?{SPACE}*+[:#]?{SPACE}*+"
SEPARATOR = r"[ \t.\-\x{00A0}]"
SENSITIVE_KEY = r"pass(?:word|wd|code|phrase)?|pwd|secret|token|api[_ -]?key|access[_ -]?key|private[_ -]?key|client[_ -]?secret|credentials?"
LABEL_KEY = r"pass(?:word|wd|code|phrase)?|pwd|secret|token|api[ _-]?key|access[ _-]?key|private[ _-]?key|client[ _-]?secret|pin|otp"
KEY_WORDS = ("pass", "pwd", "secret", "token", "key", "credential")
NOT_NAMES = (
    "Yesterday|Today|Tomorrow|Now|Just|Edited|Sent|Seen|Read|Delivered|Mon|Tue|Wed|Thu|Fri|Sat|Sun|"
    "Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday|Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec|"
    "January|February|March|April|June|July|August|September|October|November|December|Meeting|Standup|Sync|Call|Review|"
    "Lunch|Updated|Posted|Created|Modified|Last|Due|Starts?|Ends?|Daily|Weekly|Monthly|Team|Project|Sprint|Reminder|Event|"
    "Deadline|Break|Demo|Office|Hours|Planning|Retro|All"
)
GLUED = f"(?:Yesterday|Today|Tomorrow|Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday|Mon|Tue|Wed|Thu|Fri|Sat|Sun){EDGE}"
NAME_WORD = rf"(?!(?:{NOT_NAMES}){EDGE})\p{{Lu}}(?:(?!{GLUED})[\p{{L}}\p{{M}}'’.\-])*+"
PARTICLE = rf"(?:(?:de|da|di|du|van|von|der|den|del|la|le|bin|binti|al|el|ibn){SPACE}+){{0,2}}"
NAME = rf"{NAME_WORD}(?:{SPACE}+{PARTICLE}{NAME_WORD}){{0,3}}"
FULL_NAME = rf"{NAME_WORD}(?:{SPACE}+{PARTICLE}{NAME_WORD}){{1,3}}"
TIMESTAMP = (
    r"(?:(?:Yesterday|Today|Mon(?:day)?|Tue(?:sday)?|Wed(?:nesday)?|Thu(?:rsday)?|Fri(?:day)?|Sat(?:urday)?|Sun(?:day)?|"
    r"[0-9]{1,2}/[0-9]{1,2}(?:/[0-9]{2,4})?|(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.? [0-9]{1,2}(?:,? [0-9]{4})?),?"
    rf"{SPACE}+)?[0-9]{{1,2}}:[0-9]{{2}}(?:{SPACE}?[AaPp]\.?[Mm]\.?)?"
)
NOT_GENERIC = f"(?!(?:Team|All|Everyone|There|Folks|Guys|Friends|Sir|Madam|Support|Admin|Hi|Hello){EDGE})"
SECRET_LABEL_ONLY = rf"(?i)(?:^|{SPACE})(?:{LABEL_KEY}){SPACE}*[:=]?{SPACE}*\z"
PEM_LINE = r"[A-Za-z0-9+/=]{8,}|Proc-Type:[^\r\n]*|DEK-Info:[^\r\n]*|Comment:[^\r\n]*"
LOCAL = r"[\p{L}\p{N}_%+\-]"
DOMAIN_LABEL = r"[\p{L}\p{N}](?:[\p{L}\p{N}\-]{0,61}[\p{L}\p{N}])?"


def _keyed(start: str = "") -> str:
    """A sensitive key and any number of words behind it, each after one ``_`` or ``-``.

    The words are one flat run with its shape looked at from both ends, so their number and length have no bound.  A key
    with another one before it, with only such words between, is passed over: what follows the run decides for both, and a
    run of many keys is not read from each.
    """
    key = rf"{start}(?:{SENSITIVE_KEY})"
    return rf"(?={key})(?<!{key}(?=[_-])(?![A-Za-z0-9_-]{{0,128}}?[_-]{{2}})[A-Za-z0-9_-]{{1,128}}?){key}(?:[_-](?![A-Za-z0-9_-]*?[_-]{{2}})(?![_-])[A-Za-z0-9_-]*+(?<![_-]))?+"


QUOTED_KEY = rf"""\\?["']?{_keyed()}\\?["']?{SPACE}*+[:=]{SPACE}*+"""


def _quoted(quote: str) -> str:
    """Four or more characters or escapes inside quotes, written so that no engine recurses on long values."""
    inside = rf"[^{quote}\\]"
    return rf"(?=(?:\\.|{inside}){{4}}){inside}*+(?:\\.{inside}*+)*+"


_SECRET = plain(V.secret_value_ok)
_PHONE = plain(V.phone_ok)

# The patterns, with what each is called.  Rules of one name share a rank where they are one rule in parts.
_ORDER: list[list[Rule]] = [
    [Rule("PRIVATE_KEY", "secrets", r"-{5}BEGIN [A-Z ]*PRIVATE KEY-{5}", words=("PRIVATE KEY-----",))],
    [Rule("AWS_ACCESS_KEY", "secrets", rf"(?:AKIA|ASIA|ABIA|ACCA)[0-9A-Z](?:[ \t]?[0-9A-Z]){{15}}", EDGE, EDGE, words=("AKIA", "ASIA", "ABIA", "ACCA"), check=plain(V.aws_access_key_ok))],
    [Rule("GITHUB_TOKEN", "secrets", r"(?:gh[pousr]_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{40,})", EDGE, EDGE, words=("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_"))],
    [Rule("AI_API_KEY", "secrets", r"sk-(?:ant-|proj-|or-)?[A-Za-z0-9_\-\x{200b}]{20,}", words=("sk-",))],
    [Rule("HUGGINGFACE_TOKEN", "secrets", r"hf_[A-Za-z0-9]{30,}", EDGE, EDGE, words=("hf_",))],
    [Rule("SLACK_TOKEN", "secrets", r"xox[abposr]-[A-Za-z0-9\-]{10,}", EDGE, words=("xox",))],
    [Rule("SLACK_WEBHOOK", "secrets", r"https://hooks\.slack\.com/services/[A-Za-z0-9_/\-]{24,}", words=("hooks.slack.com",))],
    [Rule("GITLAB_TOKEN", "secrets", r"glpat-[A-Za-z0-9_\-]{20,}", EDGE, EDGE, words=("glpat-",))],
    [Rule("NPM_TOKEN", "secrets", r"npm_[A-Za-z0-9]{36,}", EDGE, EDGE, words=("npm_",))],
    [Rule("PYPI_TOKEN", "secrets", r"pypi-[A-Za-z0-9_\-]{20,}", EDGE, EDGE, words=("pypi-",))],
    [Rule("SENDGRID_TOKEN", "secrets", r"SG\.[A-Za-z0-9_\-]{16,}\.[A-Za-z0-9_\-]{16,}", EDGE, EDGE, words=("SG.",))],
    [Rule("DISCORD_WEBHOOK", "secrets", r"https://discord(?:app)?\.com/api/webhooks/[0-9]{16,20}/[A-Za-z0-9_\-]{20,}", words=("/api/webhooks/",))],
    [Rule("TELEGRAM_BOT", "secrets", r"[0-9]{8,10}:[A-Za-z0-9_\-]{20,}", EDGE, EDGE, trigger="[0-9]{8}:", digit=True)],
    [Rule("GOOGLE_API_KEY", "secrets", r"AIza[0-9A-Za-z_\-]{35}", EDGE, EDGE, words=("AIza",))],
    [Rule("STRIPE_KEY", "secrets", r"(?:sk|rk)_(?:[l1I]ive|test)_[0-9a-zA-Z]{16,}", EDGE, EDGE, words=("sk_", "rk_"))],
    # A run of its characters is read from the first place where it can begin, and from others 512 characters apart.
    [Rule("JWT", "secrets", r"eyJ[A-Za-z0-9_\-]{8,}+\.[A-Za-z0-9_\-]{8,}+\.[A-Za-z0-9_\-]{8,}+", rf"{EDGE}(?=eyJ)(?<!{EDGE}eyJ[A-Za-z0-9_\-]{{0,512}}?)", words=("eyJ",))],
    [Rule("CONNECTION_STRING_KEY", "secrets", r"[A-Za-z0-9+/%=]{16,}", EDGE + "(?:AccountKey|SharedAccessKey|SharedAccessSignature|sig)=", words=("AccountKey=", "SharedAccessKey=", "SharedAccessSignature=", "sig="))],
    [Rule("BEARER_TOKEN", "secrets", r"[A-Za-z0-9._~+/\-]{16,}=*", rf"{EDGE}bearer{SPACE}+", folded=("bearer",), ignore_case=True)],
    [Rule("BASIC_AUTH", "secrets", r"[A-Za-z0-9+/]{8,}={0,2}", rf"{EDGE}(?:Authorization{SPACE}*:{SPACE}*)?Basic{SPACE}+", folded=("basic",), ignore_case=True, check=plain(V.basic_auth_ok))],
    [Rule("URL_PASSWORD", "secrets", r"[^\s@/]{3,}", EDGE + r"[a-zA-Z][a-zA-Z0-9+.\-]{1,20}://[^\s:/@]+:", "@", words=("://",))],
    [Rule("URL_TOKEN", "secrets", r"[^&\s]{8,}", r"[?&](?:token|key|api_?key|sig|signature|access_token|auth|code|secret|password)=", trigger="[?&][A-Za-z_]+=", ignore_case=True, words=("?", "&"))],
    [
        Rule("PASSWORD_OR_SECRET", "secrets", _quoted('"'), QUOTED_KEY + '"', '"', ignore_case=True, check=_SECRET, folded=KEY_WORDS),
        Rule("PASSWORD_OR_SECRET", "secrets", _quoted("'"), QUOTED_KEY + "'", "'", ignore_case=True, check=_SECRET, folded=KEY_WORDS),
        Rule("PASSWORD_OR_SECRET", "secrets", r'[^"\\]{4,}', QUOTED_KEY + r'\\"', r'\\?"', ignore_case=True, check=_SECRET, folded=KEY_WORDS),
        Rule("PASSWORD_OR_SECRET", "secrets", r"[^'\\]{4,}", QUOTED_KEY + r"\\'", r"\\?'", ignore_case=True, check=_SECRET, folded=KEY_WORDS),
    ],
    [Rule("PASSWORD_OR_SECRET", "secrets", r"[^<]{3,}", rf"<({SENSITIVE_KEY}){EDGE}[^<>]*+>", r"</\2>", ignore_case=True, check=_SECRET, groups=1, words=("</",), folded=KEY_WORDS)],
    [Rule("PASSWORD_OR_SECRET", "secrets", r"""[^\s"',;]{4,}""", rf"""{_keyed("(?<![A-Za-z])")}{SPACE}*+["']?{SPACE}*+[:=]{SPACE}*+["']?""", "", ignore_case=True, check=_SECRET, extend=True, folded=KEY_WORDS)],
    [Rule("CREDIT_CARD", "financial", r"(?:[0-9][ \t\x{00A0}\-]?){12,18}[0-9]", EDGE, EDGE, trigger=r"[0-9](?:[ \t\x{00A0}\-]?[0-9]){12}", digit=True, check=plain(V.luhn_ok))],
    [Rule("IBAN", "financial", r"[A-Z]{2}[0-9]{2}(?:[ \t\x{00A0}]?[A-Z0-9]{4}){2,7}(?:[ \t\x{00A0}]?[A-Z0-9]{1,4})?", EDGE, EDGE, trigger="[A-Za-z]{2}[0-9]{2}", digit=True, ignore_case=True, check=plain(V.iban_ok))],
    [Rule("BANK_ACCOUNT", "financial", r"[0-9][0-9 \-]{5,20}[0-9]", rf"{EDGE}(?:account|acct|a/c){ID_LABEL}", EDGE, ignore_case=True, folded=("account", "acct", "a/c"), digit=True)],
    [Rule("ROUTING_NUMBER", "financial", r"[0-9]{9}", rf"{EDGE}(?:routing|aba){ID_LABEL}", EDGE, ignore_case=True, folded=("routing", "aba"), digit=True)],
    [Rule("CRYPTO_WALLET", "financial", r"(?:0x[a-fA-F0-9]{40}|bc1[a-z0-9]{25,59}|[13][a-km-zA-HJ-NP-Z1-9]{25,34})", EDGE, EDGE, trigger="0x[a-fA-F0-9]{40}|bc1|[13][a-km-zA-HJ-NP-Z1-9]{25}", digit=True)],
    [Rule("US_SSN", "government_id", r"(?!000|666|9[0-9]{2})[0-9]{3}[ \-]?(?!00)[0-9]{2}[ \-]?(?!0000)[0-9]{4}", EDGE, EDGE, trigger=r"[0-9]{3}[ \-]?[0-9]{2}[ \-]?[0-9]{4}", digit=True, check=V.ssn_context_ok, context=True)],
    [Rule("PASSPORT", "government_id", "[A-Z0-9]{6,9}", rf"{EDGE}passport{ID_LABEL}", EDGE, ignore_case=True, folded=("passport",))],
    [Rule("DRIVER_LICENSE", "government_id", r"[A-Z0-9\-]{5,15}", rf"{EDGE}(?:driver'?s?{SPACE}*+licen[sc]e|DL){ID_LABEL}", EDGE, rf"(?i)licen|{EDGE}DL", ignore_case=True, folded=("licen", "dl"))],
    [],  # the place of emails among the ranks; they are found by a rule of their own, below
    [Rule("PHONE", "contact", rf"\+[0-9]{{1,3}}{SEPARATOR}?\(?[0-9]{{1,4}}\)?(?:{SEPARATOR}?[0-9]{{2,5}}){{2,4}}{EDGE}(?:[ \t]?(?:ext\.?|x){SPACE}?[0-9]{{1,5}})?", trigger=r"\+[0-9]", digit=True, words=("+",), check=_PHONE)],
    [Rule("PHONE", "contact", rf"(?:\([0-9]{{3}}\)[ \t\x{{00A0}}]?|{EDGE}[0-9]{{3}}{SEPARATOR})[0-9]{{3}}{SEPARATOR}[0-9]{{4}}", "", EDGE, rf"[0-9]{{3}}{SEPARATOR}[0-9]{{4}}", digit=True, check=_PHONE)],
    [Rule("PHONE", "contact", "[2-9][0-9]{2}[2-9][0-9]{6}", EDGE, EDGE, "[0-9]{10}", digit=True, check=plain(V.nanp_phone_ok))],
    [Rule("PHONE", "contact", rf"0[0-9]{{2,4}}{SEPARATOR}[0-9]{{3,4}}{SEPARATOR}[0-9]{{3,4}}", EDGE, EDGE, rf"0[0-9]{{2,4}}{SEPARATOR}[0-9]", digit=True, check=_PHONE)],
    [Rule("PHONE", "contact", rf"[6-9][0-9]{{4}}{SEPARATOR}[0-9]{{5}}", EDGE, EDGE, rf"[0-9]{{5}}{SEPARATOR}[0-9]{{5}}", digit=True, check=_PHONE)],
    [Rule("PERSON", "person", FULL_NAME, rf"\A{SPACE}*", rf"(?:{SPACE}*\([^)]{{1,40}}\))?(?:{SPACE}+|(?={GLUED})){TIMESTAMP}{SPACE}*\z", "[0-9]:[0-9]", digit=True)],
    [Rule("PERSON", "person", NAME, rf"(?<![0-9A-Za-z_.])@", words=("@",))],
    [Rule("PERSON", "person", rf"{NAME_WORD}(?:{SPACE}+{NAME_WORD})?", rf"{EDGE}(?:Hi|Hello|Hey|Dear|Thanks|Thank you|Cheers|Regards|Best),?{SPACE}+{NOT_GENERIC}", words=("Hi", "Hello", "Hey", "Dear", "Thank", "Cheers", "Regards", "Best"))],
    [Rule("PERSON", "person", NAME, rf"{EDGE}(?:From|To|Cc|Bcc|Sender|Recipient|Name|Full name|Owner|Assignee|Author|Contact|Signed by){SPACE}*:{SPACE}*{NOT_GENERIC}", trigger=rf":{SPACE}*\p{{Lu}}", words=(":",))],
    [
        Rule(
            "DATE_OF_BIRTH",
            "dates",
            r"(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-3]?[0-9][/.\-][0-3]?[0-9][/.\-](?:19|20)?[0-9]{2}|[A-Za-z]{3,9}\.? [0-9]{1,2},? [0-9]{4}|[0-3]?[0-9] [A-Za-z]{3,9}\.? [0-9]{4})",
            rf"{EDGE}(?:dob|d\.o\.b\.?|date of birth|birth{SPACE}*+date|born){SPACE}*+[:#\-]?{SPACE}*+",
            "",
            ignore_case=True,
            folded=("dob", "d.o.b", "birth", "born"),
            digit=True,
        )
    ],
    [Rule("MAC_ADDRESS", "network", "(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}", EDGE, EDGE, "[:-][0-9A-Fa-f]{2}[:-][0-9A-Fa-f]{2}[:-]", words=(":", "-"))],
    [Rule("MAC_ADDRESS", "network", r"[0-9A-Fa-f]{4}\.[0-9A-Fa-f]{4}\.[0-9A-Fa-f]{4}", EDGE, EDGE, r"\.[0-9A-Fa-f]{4}\.[0-9A-Fa-f]{4}")],
    [
        Rule(
            "IP_ADDRESS",
            "network",
            r"(?:[0-9A-Fa-f]{0,4}:){2,7}(?:(?:[0-9]{1,3}\.){3}[0-9]{1,3}|[0-9A-Fa-f]{0,4})(?:%[A-Za-z0-9_.\-]*[A-Za-z0-9_\-])?",
            "(?<![0-9A-Za-z_:])",
            r"(?![0-9A-Za-z_:]|\.[0-9])",
            ":[0-9A-Fa-f]{0,4}:",
            words=(":",),
            check=plain(V.ipv6_ok),
        )
    ],
    [Rule("IP_ADDRESS", "network", r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}", EDGE, EDGE, r"\.[0-9]{1,3}\.[0-9]", digit=True, check=V.ipv4_in_context_ok, context=True)],
    [Rule("POSSIBLE_SECRET", "secrets", r"[A-Za-z0-9+/_\-]{20,}={0,2}", trigger=r"(?<![A-Za-z0-9+/_\-])[A-Za-z0-9+/_\-]{20}", digit=True, check=plain(V.possible_secret_ok), score=0.7)],
]

#: Private keys with what belongs to them come before all others, emails after them.  A key ends at its own end line, which
#: no other key's first line may come before, or behind its last line that looks like part of a key.
PEM = Rule(
    "PRIVATE_KEY",
    "secrets",
    rf"-{{5}}BEGIN ([A-Z ]*PRIVATE KEY)-{{5}}(?:[^-]*+(?:-(?!----(?:END \3-{{5}}|BEGIN ))[^-]*+)*+-{{5}}END \3-{{5}}|(?:(?:\r\n|\n|\r)[ \t]*+(?:{PEM_LINE})[ \t]*+(?=[\r\n]|\z))*+)",
    words=("PRIVATE KEY-----",),
    value_groups=1,
    rank=-100,
)
EMAIL = Rule(
    "EMAIL",
    "contact",
    rf"""(?:"[^"@]{{0,64}}"|(?!\.)(?:{LOCAL}|\.(?![.@])){{1,65}})@(?:{DOMAIN_LABEL}\.(?=[\p{{L}}\p{{N}}])){{1,127}}+[\p{{L}}\p{{N}}](?:[\p{{L}}\p{{N}}\-]{{0,61}}[\p{{L}}\p{{N}}])""",
    r"(?<![\p{L}\p{N}._%+\-@])",
    r"(?![_%])(?=[.\-]*+(?![\p{L}\p{N}.\-]))",
    words=("@",),
    check=lambda value, match: V.valid_domain(V.F.substring_index(value, "@", -1)),
    rank=52,
)


def _ranked() -> list[Rule]:
    from dataclasses import replace

    return [PEM, *(replace(r, rank=i) for i, rules in enumerate(_ORDER) for r in rules), EMAIL]


RULES: list[Rule] = _ranked()
CUSTOM_RANK = -1000
