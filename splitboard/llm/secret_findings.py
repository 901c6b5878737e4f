"""Labelled findings for the secret scan: values of known kinds in their usual surroundings, drawn by rule.

Every finding says what it was drawn as, so its label does not depend on what a classifier looks at: secrets of
issued formats and free ones on one side; on the other what is usually mistaken for one, often under the very
same names: placeholders, references to variables, prose, slugs, identifiers, digests, numbers, paths.
A team with reviewed findings of its own passes those instead.
"""

from __future__ import annotations

import base64
import json
import random
import string
import uuid
from dataclasses import dataclass


@dataclass(frozen=True)
class Finding:
    kind: str
    is_secret: bool
    before: str
    value: str
    after: str


HEX, BASE62 = "0123456789abcdef", string.ascii_letters + string.digits
BASE64, URL64 = BASE62 + "+/", BASE62 + "-_"

#: How values are introduced in code, settings, logs and prose.
SECRET_NAMES = "password passwd pwd passphrase secret token api_key apikey access_token auth_token client_secret secret_key credential".split()
PREFIXES = ["", "", "", "db_", "app_", "user_", "admin_", "my_", "service_", "root_", "smtp_", "ftp_", "prod_", "session_"]
PLAIN_NAMES = "key sort_key primary_key foreign_key cache_key partition_key public_key token_type token_count max_tokens auth_type auth_mode secret_name password_field key_name keyboard monkey author".split()
ASSIGNED = ["{n}={v}", '{n} = "{v}"', "{n}: '{v}'", '"{n}": "{v}"', "{n}: {v}", '{n} := "{v}"', "'{n}' => '{v}'", "--{n}={v}", "export {n}={v}", '{n}="{v}"', "{n} = {v}"]
TOLD = ["use {v} for this", "the key is {v} and", "found {v} in the log", "sent {v} to", "({v})", '"{v}"', "{v}", "credentials: {v}"]
DIGESTS = "sha256 sha1 md5 checksum digest etag commit revision fingerprint integrity hash build blob".split()
THINGS = "request order session object trace node device message item batch".split()
USUAL = """user name value error file line server client table index result status update report version system service default
public config module test data important required optional considerations authentication connection settings account enabled
disabled basic bearer header field string number list page total first last next""".split()
PLACEHOLDERS = ["your_{n}_here", "your-{n}-here", "changeme", "change_me_now", "<your-{n}>", "xxxxxxxxxxxx", "************", "REPLACE_ME", "insert_{n}", "example_{n}", "undefined", "placeholder", "not_set_yet", "my-{n}-goes-here", "TODO_SET_{n}"]
REFERENCES = ["${{{n}}}", "$({n})", "{{{{{n}}}}}", "os.environ.{n}", "process.env.{n}", "config.{n}", "settings.{n}", "self.{n}", "request.form.{n}", "vault.read.{n}", "%({n})s", "args.{n}"]
LEET = str.maketrans("aeios", "@3105")


def cased(rng: random.Random, name: str) -> str:
    """A name as code writes it."""
    parts = name.split("_")
    return rng.choice([name, name, name.upper(), "-".join(parts), parts[0] + "".join(p.title() for p in parts[1:])])


def drawn(rng: random.Random, alphabet: str, n: int) -> str:
    return "".join(rng.choices(alphabet, k=n))


def token_of_three(rng: random.Random) -> str:
    part = lambda x: base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=")
    return ".".join([part({"alg": rng.choice(["HS256", "RS256"]), "typ": "JWT"}), part({"sub": drawn(rng, string.digits, 8), "iat": rng.randint(1_500_000_000, 1_900_000_000)}), drawn(rng, URL64, 43)])


def password(rng: random.Random, words: list[str]) -> str:
    """What people type: words with changed letters, digits and signs, or noise."""
    word = rng.choice(words)
    word = rng.choice([word, word.title(), word.translate(LEET), word.title().translate(LEET)])
    tail = drawn(rng, string.digits, rng.randint(2, 4)) + rng.choice(["", "!", "#", "$", "!?"])
    made = rng.choice([word + tail, word + rng.choice("!@#$%_-.") + tail, tail + word + drawn(rng, string.ascii_lowercase, 3), drawn(rng, BASE62 + "!@#$%^&*-_=+", rng.randint(9, 20))])
    return made if len(made) >= 8 else made + drawn(rng, BASE62, 8 - len(made))


#: Published shapes of issued secrets. Each entry draws (value, name or None).
ISSUED = {
    "aws-access-key": lambda r: (r.choice(["AKIA", "ASIA"]) + drawn(r, string.ascii_uppercase + "234567", 16), r.choice([None, "aws_access_key_id"])),
    "aws-secret-key": lambda r: (drawn(r, BASE64, 40), r.choice(["aws_secret_access_key", "secret_access_key"])),
    "github-token": lambda r: (f"gh{r.choice('pousr')}_{drawn(r, BASE62, 36)}", r.choice([None, "github_token"])),
    "slack-token": lambda r: (f"xox{r.choice('abpr')}-{drawn(r, string.digits, 11)}-{drawn(r, string.digits, 12)}-{drawn(r, BASE62, 24)}", r.choice([None, "slack_token"])),
    "stripe-key": lambda r: (f"{r.choice(['sk', 'rk'])}_{r.choice(['live', 'test'])}_{drawn(r, BASE62, 24)}", r.choice([None, "stripe_key"])),
    "google-key": lambda r: ("AIza" + drawn(r, URL64, 35), r.choice([None, "google_api_key"])),
    "mail-key": lambda r: (f"SG.{drawn(r, URL64, 22)}.{drawn(r, URL64, 43)}", "sendgrid_api_key"),
    "package-token": lambda r: ("npm_" + drawn(r, BASE62, 36), r.choice([None, "npm_token"])),
    "web-token": lambda r: (token_of_three(r), r.choice([None, "authorization_token", "access_token"])),
}


def free_secret(rng: random.Random, kind: str, words: list[str]) -> tuple[str, str]:
    name = rng.choice(PREFIXES) + rng.choice(SECRET_NAMES)
    if kind == "hex":
        return drawn(rng, HEX, rng.choice([16, 18, 20, 24, 32, 40, 48, 64])), name
    if kind == "noise":
        return drawn(rng, rng.choice([BASE62, BASE64, URL64]), rng.randint(16, 64)) + rng.choice(["", "", "=", "=="]), name
    return password(rng, words), name


def mistaken(rng: random.Random, kind: str, words: list[str]) -> tuple[str, str | None]:
    """(value, name or None) of a value that is no secret."""
    own, slug = rng.choice(PREFIXES) + rng.choice(SECRET_NAMES), lambda n, sep: sep.join(rng.choice(words) for _ in range(n))
    if kind == "placeholder":
        return rng.choice(PLACEHOLDERS).format(n=own), own
    if kind == "reference":
        return rng.choice(REFERENCES).format(n=rng.choice([own, own.upper()])), own
    if kind == "named-prose":
        return slug(rng.randint(2, 3), rng.choice("-_.")), rng.choice([own, own, rng.choice(PLAIN_NAMES)])
    if kind == "word":
        word = max((rng.choice(words) for _ in range(4)), key=len)
        return (word if len(word) >= 8 else slug(2, "-")), rng.choice([own, rng.choice(PLAIN_NAMES)])
    if kind == "slug":
        return slug(rng.randint(3, 6), rng.choice("-_")), None
    if kind == "identifier":
        parts = [rng.choice(words) for _ in range(rng.randint(3, 4))]
        return rng.choice([parts[0] + "".join(p.title() for p in parts[1:]), "_".join(parts).upper(), "".join(p.title() for p in parts)]), rng.choice([None, None, rng.choice(PLAIN_NAMES)])
    if kind == "uuid":
        return str(uuid.UUID(int=rng.getrandbits(128), version=4)), rng.choice([None, f"{rng.choice(THINGS)}_id", f"{rng.choice(THINGS)}_key", f"{rng.choice(THINGS)}_token"])
    if kind == "digest":
        return drawn(rng, HEX, rng.choice([32, 40, 40, 64])), rng.choice([rng.choice(DIGESTS), rng.choice(DIGESTS), "cache_key", "content_key", None])
    if kind == "number":
        return drawn(rng, string.digits, rng.randint(8, 24)), rng.choice([None, None, rng.choice(PLAIN_NAMES), f"{rng.choice(THINGS)}_key"])
    if kind == "path":
        return "/".join(rng.choice(words) for _ in range(rng.randint(3, 6))) + rng.choice(["", ".py", "/index.html"]), rng.choice([None, None, "key", "key_file", "token_path", "secret_file"])
    if kind == "stamp":
        day = f"20{rng.randint(10, 29)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}"
        return rng.choice([f"{day}-{drawn(rng, string.digits, 6)}", f"{day}T{rng.randint(0, 23):02}-{rng.randint(0, 59):02}-00Z", f"build-{day}-{drawn(rng, HEX, 7)}"]), rng.choice([None, "sort_key", "partition_key"])
    return rng.choice("=-_+/ax") * rng.randint(16, 40), None  # rulers and runs of one sign


FREE = ["hex", "noise", "password"]
MISTAKEN = ["placeholder", "reference", "named-prose", "word", "slug", "identifier", "uuid", "digest", "number", "path", "stamp", "ruler"]


def labelled_findings(seed: int, per_kind: int = 60, words: list[str] | None = None) -> list[Finding]:
    """per_kind findings of every kind, the free kinds three times as many; words (USUAL if none) make the prose around and inside them."""
    rng, words = random.Random(seed), [w for w in words or [] if len(w) >= 3] + USUAL
    out = []

    def place(kind: str, is_secret: bool, value: str, name: str | None) -> None:
        prose = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(0, 6)))
        gap = rng.choice([" ", " ", "\n", ", ", "; "])
        if name is None:
            about = rng.choice(DIGESTS) + rng.choice([" ", ": ", ":"]) if kind == "digest" else ""
            left, right = (rng.choice(["{v}", "({v})", '"{v}"', "see {v} here"]) if not is_secret else rng.choice(TOLD)).split("{v}")
            left = left + about
        else:
            left, right = rng.choice(ASSIGNED).replace("{n}", cased(rng, name)).split("{v}")
        out.append(Finding(kind, is_secret, prose() + gap + left, value, right + rng.choice([" ", "\n", " "]) + prose()))

    for kind, made in ISSUED.items():
        for _ in range(per_kind):
            place(kind, True, *made(rng))
    for kind in FREE:
        for _ in range(3 * per_kind):
            place(kind, True, *free_secret(rng, kind, words))
    for _ in range(per_kind):
        place("url-password", True, password(rng, words).replace("@", "a").replace("/", "b"), None)
        user, host = rng.choice(words), rng.choice(words)
        last = out.pop()
        out.append(Finding(last.kind, True, f"{rng.choice(words)} {rng.choice(['postgres', 'mysql', 'https', 'amqp', 'redis'])}://{user}:", last.value, f"@{host}.example/{rng.choice(words)} "))
        out.append(Finding("private-key", True, f"-----BEGIN {rng.choice(['', 'RSA ', 'EC '])}PRIVATE KEY-----", "\n" + "\n".join(drawn(rng, BASE64, 64) for _ in range(4)) + "\n", "-----END"))
        out.append(Finding("url-part", False, f"{rng.choice(words)} https://{host}.example/{user}/", rng.choice(["-".join(rng.choice(words) for _ in range(4)), drawn(rng, HEX, 24)]), rng.choice([" ", "/", ".html"])))
    for kind in MISTAKEN:
        for _ in range(2 * per_kind):
            place(kind, False, *mistaken(rng, kind, words))
    return out
