"""Command line: cat, inspect and combine.  python -m tessera.cli cat FILE [N]"""

from __future__ import annotations

import argparse
import getpass
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .errors import TesseraError
from .functions.privacy import renderable
from .operators.combine import combine
from .sources.inspect import Inspector
from .sources.keys import Encryption, Key
from .sources.reader import Reader
from .sources.writer import CODECS, Options


def session() -> SparkSession:
    spark = SparkSession.builder.appName("tessera").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tessera")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("cat", help="rows as JSON lines")
    c.add_argument("file")
    c.add_argument("n", nargs="?", type=int)
    keys = dict(action="append", default=None, metavar="KEY", help="a key of encrypted files: hex digits, hex:..., base64:..., raw:..., env:NAME, or - to be asked")
    c.add_argument("--key", **keys)
    i = sub.add_parser("inspect", help="what files hold")
    i.add_argument("file")
    i.add_argument("--format", choices=["text", "json", "html"], default="text")
    i.add_argument("--pages", action="store_true")
    i.add_argument("--verify-checksums", action="store_true")
    m = sub.add_parser("combine", help="files into one dataset")
    m.add_argument("inputs", nargs="+")
    m.add_argument("--output", required=True)
    m.add_argument("--schema", choices=["union", "intersect"])
    m.add_argument("--compression", choices=sorted(CODECS), default="snappy")
    m.add_argument("--key", **keys)
    m.add_argument("--encrypt-key", metavar="KEY", help="encrypts the output, footer and columns alike")
    m.add_argument("--plaintext", action="store_true", help="writes encrypted inputs without encryption")
    k = sub.add_parser("key", help="a new key, in hex")
    k.add_argument("--bits", type=int, default=256)
    return p


def key_of(text: str, ask=getpass.getpass) -> Key:
    """A key as it is told on the command line."""
    if text == "-":
        text = ask("key: ")
    if text.startswith("env:"):
        if text[4:] not in os.environ:
            raise ValueError(f"no environment variable {text[4:]}")
        text = os.environ[text[4:]]
    return Key.parse(text)


def keys_of(texts: list[str] | None) -> list[Key] | None:
    return None if texts is None else [key_of(x) for x in texts]


def main(args: list[str] | None = None, spark: SparkSession | None = None, out=sys.stdout) -> int:
    a = parser().parse_args(args)
    try:
        if a.command == "key":
            print(Key.generate(a.bits).hex(), file=out)
            return 0
        spark = spark or session()
        if a.command == "cat":
            df = Reader(spark, a.file, keys=keys_of(a.key)).read(limit=a.n)
            shown = df.select(F.to_json(F.struct(*(renderable(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields)), {"ignoreNullFields": "false"}))
            for r in shown.toLocalIterator():
                print(r[0], file=out)
        elif a.command == "inspect":
            found = Inspector(spark, a.file)
            print(getattr(found, f"to_{a.format}")(pages=a.pages, verify=a.verify_checksums), file=out)
        else:
            if a.output in a.inputs:
                raise ValueError("the output is one of the inputs")
            if a.encrypt_key and a.plaintext:
                raise ValueError("--encrypt-key and --plaintext exclude each other")
            keys = keys_of(a.key)
            encryption = Encryption(key_of(a.encrypt_key)) if a.encrypt_key else None
            r = combine(spark, [Reader(spark, x, keys=keys) for x in a.inputs], a.output, a.schema, Options(compression=a.compression, encryption=encryption, plaintext=a.plaintext))
            print(f"{r.rows} rows", file=out)
    except (TesseraError, ValueError, FileNotFoundError) as e:
        print(f"tessera: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
