"""
Labelled findings to train secret scans on, where nobody has labelled a corpus's own: lines with a value that is a secret in one of the
usual forms, or looks like one and isn't. Lines are made in Spark from their number and a seed, so reruns agree.
"""

from __future__ import annotations

import base64
import random
import string
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: What stands around the values.
TALK = "the service reads this value from its settings before it opens the connection and writes a line to the log".split()
PATHS = "config/prod.env src/app/settings.py docs/readme.md web notes deploy/values.yaml".split()
SAMPLE_PATHS = "docs/example.md tests/fixtures/sample.env test/data".split()
PLACES = "your_api_key_here example_password changeme_placeholder sample_token_value dummy_secret_value test_password_only fake_credential_for_tests".split()
PARTS = "get user authentication token from request header validate session password field manager factory internal service response builder".split()


def _of(r: random.Random, chars: str, low: int, high: int) -> str:
    return "".join(r.choice(chars) for _ in range(r.randint(low, high)))


#: Heads of keys that services hand out.
HEADS = "sk_live_ rk_live_ xoxb- AIza glpat- npm_ dop_v1_".split()
#: Numbers of forms, as _positive and _negative know them.
FORMS = 12


def _positive(r: random.Random, kind: int) -> tuple[str, str]:
    """A line of a form and its secret."""
    alnum, hexes = string.ascii_letters + string.digits, "0123456789abcdef"
    plain = lambda: r.choice((_of(r, hexes, 32, 64), _of(r, alnum, 16, 48), base64.b64encode(r.randbytes(24)).decode(), _of(r, string.ascii_lowercase, 3, 6).title() + _of(r, string.digits, 3, 5) + r.choice("!x_-") + _of(r, alnum, 3, 6)))
    name = r.choice("password passwd secret token api_key access_key auth_token private_key DB_PASSWORD PRODUCTION_SECRET_KEY client_secret".split())
    if kind < 3:
        v = plain()
        gap = " " * r.randint(0, 4)
        return r.choice((f'{name}{gap}={gap}"{v}"', f"{name}{gap}={gap}{v}", f'"{name}": "{v}"', f"{name}: {v}", f"export {name.upper()}={v}")), v
    if kind == 3:
        v = plain().rstrip("=")
        return r.choice((f"Authorization: Bearer {v}", f"curl -H 'authorization: token {v}'")), v
    if kind == 4:
        v = _of(r, alnum, 10, 24)
        return f"{r.choice(('postgres', 'mysql', 'amqp', 'https'))}://{r.choice(('admin', 'bob', 'app'))}:{v}@db{r.randint(1, 9)}.host.net:5432/main", v
    if kind == 5:
        v = "AKIA" + _of(r, string.ascii_uppercase + string.digits, 16, 16)
        return f"aws_access_key_id = {v}", v
    if kind == 6:
        v = r.choice(("ghp_", "gho_", "ghs_")) + _of(r, alnum, 36, 36)
        return f"{r.choice(('the deploy uses', 'login with', 'key'))} {v}", v
    if kind == 8:
        v = r.choice(HEADS) + _of(r, alnum, 20, 40)
        return r.choice((f"{v}", f"use {v} for billing", f"- {v}")), v
    if kind == 9:  # short ones
        v = _of(r, string.ascii_lowercase, 2, 5) + _of(r, string.digits, 2, 4) + r.choice(("", "!", "#", ",x7"))
        v += _of(r, string.digits, 1, 1) * max(0, 5 - len(v))
        return r.choice((f"{name}={v}", f'{name}: "{v}"', f"{name} = '{v}'")), v
    if kind == 10:  # several words in quotes
        v = " ".join(_of(r, string.ascii_lowercase, 3, 7) for _ in range(r.randint(2, 4))) + " " + _of(r, string.digits, 2, 4)
        return r.choice((f'{name} = "{v}"', f"passphrase: '{v}'")), v
    if kind == 11:
        v = base64.b64encode(r.randbytes(r.randint(24, 48))).decode().rstrip("=").replace("/", "a").replace("+", "B")
        return r.choice((f"{v}", f"then paste {v} here")), v
    head = base64.urlsafe_b64encode(b'{"alg":"HS256","typ":"JWT"}').decode().rstrip("=")
    v = ".".join((head, base64.urlsafe_b64encode(r.randbytes(45)).decode().rstrip("="), base64.urlsafe_b64encode(r.randbytes(32)).decode().rstrip("=")))
    return r.choice((f"cookie session={v}", f"jwt {v}")), v


def _negative(r: random.Random, kind: int) -> tuple[str, str]:
    """A line of a form and a value that looks like a secret."""
    hexes = "0123456789abcdef"
    name = r.choice("password passwd secret token api_key access_key auth_token private_key".split())
    if kind == 0:
        v = _of(r, hexes, 40, 40)
        return f"commit {v}", v
    if kind == 1:
        name, n = r.choice((("sha256", 64), ("md5", 32), ("sha1", 40)))
        v = _of(r, hexes, n, n)
        return r.choice((f"{name}: {v}", f"{name}sum {v}", f"checksum = {v}")), v
    if kind == 2:
        v = str(uuid.UUID(bytes=r.randbytes(16)))
        return r.choice((f"uuid {v}", f"request uuid={v}")), v
    if kind == 3:
        v = r.choice(PLACES)
        return r.choice((f"password = {v}", f'api_key: "{v}"', f"token={v}")), v
    if kind == 4:
        words = [r.choice(PARTS) for _ in range(r.randint(4, 7))]
        v = words[0] + "".join(w.title() for w in words[1:])
        return f"call {v}{'x' * max(0, 20 - len(v))} here", v + "x" * max(0, 20 - len(v))
    if kind == 5:
        v = "_".join(r.choice(PARTS) for _ in range(r.randint(4, 7)))
        v += "_value" * (len(v) < 20)
        return f"see {v}{'_' * max(0, 20 - len(v))} for more", v + "_" * max(0, 20 - len(v))
    if kind == 6:
        v = r.choice("a-=_x0") * r.randint(20, 60)
        return f"{v}", v
    if kind == 8:
        v = r.choice(("${" + name.upper() + "}", "$(" + r.choice(PARTS) + "_" + r.choice(PARTS) + ")", "{{" + name + "}}", "%" + name.upper() + "%"))
        return r.choice((f"{name}={v}", f'{name}: "{v}"')), v
    if kind == 9:
        v = r.choice(PARTS) + "." + r.choice(PARTS) + r.choice(("()", "[0]", "." + r.choice(PARTS)))
        return r.choice((f"{name} = {v}", f"{name}: {v}")), v
    if kind == 10:
        v = r.choice("********* xxxxxxxx required optional redacted undefined string Optional[str] <hidden>".replace("<hidden>", "missing").split())
        return r.choice((f"{name}: {v}", f"{name} = {v}")), v
    if kind == 11:
        v = " ".join(r.choice(TALK) for _ in range(r.randint(3, 7)))
        return r.choice((f'{name}: "{v}"', f"{name} = '{v}'")), v
    v = "/".join(r.choice(PARTS) for _ in range(r.randint(4, 8)))
    v += "/more" * (len(v) < 20) + "/" * max(0, 15 - len(v))
    return f"path {v} is open", v


def planted(spark: SparkSession, lines: int, seed: int = 11) -> DataFrame:
    """`lines` rows, half of them secrets: doc_id, text, source, start, value, label (1 or 0) and form, its number."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i in batch["id"].tolist():
                r = random.Random(seed * 1_000_003 + i)
                form = r.randrange(FORMS)
                line, value = (_positive if i % 2 else _negative)(r, form)
                before, after = (" ".join(r.choice(TALK) for _ in range(r.randint(0, 8))) for _ in range(2))
                text = f"{before}\n{line}\n{after}"
                sample = i % 2 == 0 and r.random() < 0.2
                out.append((i, text, r.choice(SAMPLE_PATHS if sample else PATHS), len(before) + 1 + line.index(value), value, float(i % 2), form))
            yield pd.DataFrame(out, columns=["doc_id", "text", "source", "start", "value", "label", "form"])

    return spark.range(lines).mapInPandas(run, "doc_id long, text string, source string, start long, value string, label double, form int")
