"""Keys of encrypted files, and Parquet modular encryption by Spark's own reader and writer.

Parquet asks a class of the executors for a file's keys.  That class is compiled here, once for an application, with the
compiler that Spark has for its generated code, and sent to the executors as a jar; so encrypted files are read with
column pruning and pushdown like any others.  Keys are told to it by options whose names Spark hides in its listings.
A missing or wrong key raises DecryptionError.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import hmac
import io
import secrets
import uuid
import zipfile
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..errors import DecryptionError, UnsupportedError
from ..schema import Schema
from . import thrift
from .footer import end_of, files_of
from .storage import scratch

SIZES = (128, 192, 256)


class Key:
    """An AES key.  Its id tells keys apart without giving anything of them away; repr shows the id alone."""

    def __init__(self, raw: bytes):
        if 8 * len(raw) not in SIZES:
            raise ValueError("a key has 128, 192 or 256 bits")
        self.raw = bytes(raw)

    @classmethod
    def generate(cls, bits: int = 256) -> Key:
        if bits not in SIZES:
            raise ValueError("a key has 128, 192 or 256 bits")
        return cls(secrets.token_bytes(bits // 8))

    @classmethod
    def from_hex(cls, text: str) -> Key:
        try:
            return cls(bytes.fromhex(text))
        except ValueError as e:
            raise ValueError("not the hex digits of a key") from e

    @classmethod
    def parse(cls, text: str) -> Key:
        """A key from hex digits, or from hex:..., base64:... or raw:... ."""
        kind, colon, rest = text.partition(":")
        if not colon:
            return cls.from_hex(text)
        if kind == "hex":
            return cls.from_hex(rest)
        if kind == "raw":
            return cls(rest.encode())
        if kind == "base64":
            try:
                return cls(base64.b64decode(rest, validate=True))
            except binascii.Error as e:
                raise ValueError("not the base64 of a key") from e
        raise ValueError(f"no notation {kind!r} for keys")

    @property
    def bits(self) -> int:
        return 8 * len(self.raw)

    def hex(self) -> str:
        return self.raw.hex()

    @property
    def id(self) -> str:
        return hmac.new(self.raw, b"tessera key id", hashlib.sha256).hexdigest()[:16]

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Key) and hmac.compare_digest(self.raw, other.raw)

    def __hash__(self) -> int:
        return hash(self.id)

    def __repr__(self) -> str:
        return f"Key({self.bits} bits, id {self.id})"


@dataclass(frozen=True)
class Encryption:
    """How files are encrypted: the footer's key, keys of single columns (none: all have the footer's), whether the footer
    stays readable, and a prefix of what is authenticated, which may be left out of the files."""

    footer: Key
    columns: dict[str, Key] = field(default_factory=dict)
    plaintext_footer: bool = False
    algorithm: str = "AES_GCM_V1"
    aad_prefix: bytes | None = None
    store_aad_prefix: bool = True

    def __post_init__(self):
        if self.algorithm not in ALGORITHMS:
            raise UnsupportedError(f"no algorithm {self.algorithm!r}")
        if any(k.bits == 192 for k in (self.footer, *self.columns.values())):
            raise ValueError("192-bit keys aren't portable; use 128 or 256 bits")
        if not self.store_aad_prefix and not self.aad_prefix:
            raise ValueError("there is no prefix to leave out")

    def only(self, names: list[str]) -> Encryption:
        """The same for files that have these columns only."""
        return replace(self, columns={c: k for c, k in self.columns.items() if c in names or c.split(".")[0] in names})


ALGORITHMS = ("AES_GCM_V1", "AES_GCM_CTR_V1")
#: keys: a list of Keys, or a function of a key's metadata in the file (for files written here, the key's id).
Keyring = list[Key] | Callable[[str], Key | None]

FACTORY = "tessera.Keys"
_SOURCE = """
package tessera;

import java.util.HashMap;
import java.util.Map;
import org.apache.hadoop.conf.Configuration;
import org.apache.hadoop.fs.Path;
import org.apache.parquet.crypto.*;
import org.apache.parquet.hadoop.api.WriteSupport;
import org.apache.parquet.hadoop.metadata.ColumnPath;

public class Keys implements EncryptionPropertiesFactory, DecryptionPropertiesFactory, DecryptionKeyRetriever {
  private final Map known = new HashMap();

  static byte[] bytes(String hex) {
    byte[] out = new byte[hex.length() / 2];
    for (int i = 0; i < out.length; i++) out[i] = (byte) Integer.parseInt(hex.substring(2 * i, 2 * i + 2), 16);
    return out;
  }

  static String hex(byte[] raw) {
    StringBuilder out = new StringBuilder();
    for (int i = 0; i < raw.length; i++) out.append(String.format("%02x", new Object[] {Integer.valueOf(raw[i] & 255)}));
    return out.toString();
  }

  static String text(String hex) {
    try {
      return new String(bytes(hex), "UTF-8");
    } catch (java.io.UnsupportedEncodingException e) {
      throw new RuntimeException(e);
    }
  }

  public byte[] getKey(byte[] metadata) throws KeyAccessDeniedException {
    Object found = metadata == null ? null : known.get(hex(metadata));
    if (found == null) throw new KeyAccessDeniedException("no key for one of the columns or the footer");
    return (byte[]) found;
  }

  public FileEncryptionProperties getFileEncryptionProperties(Configuration conf, Path file, WriteSupport.WriteContext context) {
    String footer = conf.get("tessera.secret.footer");
    if (footer == null) return null;
    String[] parts = footer.split("=");
    FileEncryptionProperties.Builder b = FileEncryptionProperties.builder(bytes(parts[0])).withFooterKeyMetadata(bytes(parts[1])).withAlgorithm(ParquetCipher.valueOf(conf.get("tessera.secret.algorithm")));
    if (conf.getBoolean("tessera.secret.plaintext", false)) b.withPlaintextFooter();
    String columns = conf.get("tessera.secret.columns", "");
    if (columns.length() > 0) {
      Map encrypted = new HashMap();
      String[] each = columns.split(";");
      for (int i = 0; i < each.length; i++) {
        String[] x = each[i].split("=");
        ColumnPath path = ColumnPath.fromDotString(text(x[0]));
        encrypted.put(path, ColumnEncryptionProperties.builder(path).withKey(bytes(x[1])).withKeyMetaData(bytes(x[2])).build());
      }
      b.withEncryptedColumns(encrypted);
    }
    String aad = conf.get("tessera.secret.aad");
    if (aad != null) {
      b.withAADPrefix(bytes(aad));
      if (!conf.getBoolean("tessera.secret.aad.stored", true)) b.withoutAADPrefixStorage();
    }
    return b.build();
  }

  public FileDecryptionProperties getFileDecryptionProperties(Configuration conf, Path file) {
    String keys = conf.get("tessera.secret.keys");
    if (keys == null) return null;
    String[] each = keys.split(";");
    for (int i = 0; i < each.length; i++) {
      String[] x = each[i].split("=");
      if (x.length == 2) known.put(x[0], bytes(x[1]));
    }
    FileDecryptionProperties.Builder b = FileDecryptionProperties.builder().withKeyRetriever(this).withPlaintextFilesAllowed();
    String aad = conf.get("tessera.secret.aad");
    if (aad != null) b.withAADPrefix(bytes(aad));
    if (conf.getBoolean("tessera.secret.unsigned", false)) b.withoutFooterSignatureVerification();
    return b.build();
  }
}
"""
_installed: set[str] = set()


def install(spark: SparkSession) -> None:
    """Compiles the class that knows keys and sends it to the executors, once for an application."""
    sc = spark.sparkContext
    if sc.applicationId in _installed:
        return
    jvm = spark._jvm
    compiler = jvm.org.codehaus.janino.SimpleCompiler()
    compiler.setParentClassLoader(jvm.java.lang.Thread.currentThread().getContextClassLoader())
    compiler.cook(_SOURCE)
    codes, jar = compiler.getBytecodes(), io.BytesIO()
    _define(spark, codes)
    with zipfile.ZipFile(jar, "w") as z:
        for name in codes:
            z.writestr(name.replace(".", "/") + ".class", bytes(codes[name]))
    path = scratch(spark, f"keys-{uuid.uuid4().hex}") + ".jar"
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(jpath)
    out.write(jar.getvalue())
    out.close()
    fs.deleteOnExit(jpath)
    spark._jsc.addJar(path)
    _installed.add(sc.applicationId)


def _define(spark: SparkSession, codes) -> None:
    """Makes the class known to the driver, whose configurations look it up beside Parquet's own classes."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    of = jvm.java.lang.Class.forName
    home = of("org.apache.parquet.crypto.FileDecryptionProperties").getClassLoader()
    try:
        of(FACTORY, False, home)
        return  # an earlier application in this JVM has defined it
    except Py4JJavaError as e:
        if "ClassNotFoundException" not in str(e.java_exception):
            raise
    kinds, args = gateway.new_array(jvm.java.lang.Class, 4), gateway.new_array(jvm.java.lang.Object, 4)
    number = of("java.lang.Integer").getField("TYPE").get(None)
    for k, kind in enumerate((of("java.lang.String"), of("[B"), number, number)):
        kinds[k] = kind
    define = of("java.lang.ClassLoader").getDeclaredMethod("defineClass", kinds)
    define.setAccessible(True)
    for name in codes:
        code = bytes(codes[name])
        for k, x in enumerate((name, code, 0, len(code))):
            args[k] = x
        define.invoke(home, args)


def write_options(e: Encryption) -> dict[str, str]:
    out = {
        "parquet.crypto.factory.class": FACTORY,
        "tessera.secret.footer": f"{e.footer.hex()}={e.footer.id.encode().hex()}",
        "tessera.secret.algorithm": e.algorithm,
        "tessera.secret.plaintext": str(e.plaintext_footer).lower(),
        "tessera.secret.columns": ";".join(f"{c.encode().hex()}={k.hex()}={k.id.encode().hex()}" for c, k in e.columns.items()),
    }
    if e.aad_prefix:
        out |= {"tessera.secret.aad": e.aad_prefix.hex(), "tessera.secret.aad.stored": str(e.store_aad_prefix).lower()}
    return out


@dataclass(frozen=True)
class Described:
    """What a file tells of its encryption, with the keys that a keyring has.  ring: (key metadata, key); missing: columns without a
    key; unsigned: the footer is readable and its key unknown, so that its signature can't be verified; empty: the file has no row
    group, so that it tells nothing of columns' keys."""

    encryption: Encryption
    ring: tuple[tuple[bytes, Key], ...]
    missing: tuple[str, ...]
    unsigned: bool
    empty: bool = False

    def read_options(self) -> dict[str, str]:
        e = self.encryption
        out = {"parquet.crypto.factory.class": FACTORY, "tessera.secret.keys": ";".join(f"{m.hex()}={k.hex()}" for m, k in self.ring)}
        if self.unsigned:
            out["tessera.secret.unsigned"] = "true"
        return out | ({"tessera.secret.aad": e.aad_prefix.hex()} if e.aad_prefix and not e.store_aad_prefix else {})

    def properties(self, jvm):
        """The same for Parquet's library on the driver."""
        crypto, b = jvm.org.apache.parquet.crypto, jvm.org.apache.parquet.crypto.FileDecryptionProperties.builder()
        b = b.withFooterKey(self.encryption.footer.raw)
        if self.encryption.columns:
            keys = jvm.java.util.HashMap()
            for c, k in self.encryption.columns.items():
                path = jvm.org.apache.parquet.hadoop.metadata.ColumnPath.fromDotString(c)
                keys.put(path, crypto.ColumnDecryptionProperties.builder(path).withKey(k.raw).build())
            b = b.withColumnKeys(keys)
        if self.encryption.aad_prefix and not self.encryption.store_aad_prefix:
            b = b.withAADPrefix(self.encryption.aad_prefix)
        if self.unsigned:
            b = b.withoutFooterSignatureVerification()
        return b.withPlaintextFilesAllowed().build()


def finder(keys: Keyring) -> Callable[[str], Key | None]:
    return keys if callable(keys) else {k.id: k for k in keys}.get


def describe(spark: SparkSession, path: str, keys: Keyring, aad_prefix: bytes | None = None) -> Described | None:
    """A file's encryption, by its own notes; None for a plain file.  The footer's key must be known, unless its footer is readable."""
    magic, raw = end_of(spark, path)
    find = finder(keys)
    if magic not in (b"PAR1", b"PARE"):
        return None

    def key_of(metadata: bytes | None) -> Key | None:
        return find(metadata.decode("utf-8", "replace")) if metadata is not None else None

    decoder = thrift.Decoder(raw)
    first = decoder.record()
    hidden = magic == b"PARE"
    algorithm_field, key_field = (1, 2) if hidden else (8, 9)
    if algorithm_field not in first:
        return None
    kind, (_, details) = next(iter(first[algorithm_field][1].items()))
    stored, unique = (details[n][1] if n in details else b"" for n in (1, 2))
    prefix = stored or aad_prefix
    if 3 in details and details[3][1] and not aad_prefix:
        raise DecryptionError(f"{path}: it needs the prefix of its authenticated data")
    metadata = first[key_field][1] if key_field in first else None
    footer_key = key_of(metadata)
    if footer_key is None and hidden:
        raise DecryptionError(f"{path}: no key for the footer")
    if hidden:
        module = raw[decoder.at :]
        crypto = spark._jvm.javax.crypto
        cipher = crypto.Cipher.getInstance("AES/GCM/NoPadding")
        try:
            cipher.init(2, crypto.spec.SecretKeySpec(footer_key.raw, "AES"), crypto.spec.GCMParameterSpec(128, module[4:16]))
            cipher.updateAAD((prefix or b"") + unique + b"\0")
            first = thrift.Decoder(bytes(cipher.doFinal(module[16 : 4 + int.from_bytes(module[:4], "little")]))).record()
        except Exception as e:
            raise DecryptionError(f"{path}: the footer's key is wrong") from e
    ring = {} if footer_key is None or metadata is None else {metadata: footer_key}
    columns, missing = {}, []
    groups = first[thrift.ROW_GROUPS][1][1]
    for group in groups[:1]:
        for chunk in group[1][1][1]:
            union = chunk[8][1] if 8 in chunk else {}
            if 2 not in union:
                continue
            own = union[2][1]
            name, meta = ".".join(x.decode() for x in own[1][1][1]), own[2][1] if 2 in own else None
            key = key_of(meta)
            if key is None:
                missing.append(name)
            else:
                columns[name], ring[meta] = key, key
    found = Encryption(footer_key or Key(bytes(16)), columns, not hidden, ALGORITHMS[kind - 1], prefix or None, bool(stored) or not prefix)
    return Described(found, tuple(ring.items()), tuple(missing), footer_key is None, not groups)


def describe_all(spark: SparkSession, paths: list[str], keys: Keyring) -> tuple[str, Described | None]:
    """The first file that has row groups (of files without any, the first), and its encryption, which is that of all the files.
    Spark leaves a file without rows where a write's first task has none."""
    first = None
    for path in paths:
        found = describe(spark, path, keys)
        if not found or not found.empty:
            return path, found
        first = first or (path, found)
    return first


def write_encrypted(df: DataFrame, folder: str, encryption: Encryption) -> int:
    """Writes df as encrypted files below folder; returns the number of rows.  The output appears as a whole or not at all."""
    unknown = [c for c in encryption.columns if c.split(".")[0] not in df.columns]
    if unknown:
        raise ValueError(f"no column {unknown[0]!r}")
    install(df.sparkSession)
    counted = Observation()
    df.observe(counted, F.count(F.lit(1)).alias("rows")).write.options(**write_options(encryption)).parquet(folder)
    return counted.get["rows"]


def read_encrypted(spark: SparkSession, path: str, keys: Keyring, schema: Schema | None = None, columns: list[str] | None = None, aad_prefix: bytes | None = None) -> DataFrame:
    """A DataFrame over encrypted files, whose filters and columns are pushed down.  Columns that aren't asked for need no key."""
    install(spark)
    files = files_of(spark, path)
    found = [describe(spark, f, keys, aad_prefix) for f in files]
    ring = tuple({m: k for d in found if d for m, k in d.ring}.items())
    options = replace(next(d for d in found if d), ring=ring, unsigned=any(d.unsigned for d in found if d)).read_options() if any(found) else {}
    missing = {c for d in found if d for c in d.missing}
    read = spark.read.options(**options)
    try:
        df = (read.schema(schema.to_spark()) if schema else read).parquet(*files)
    except Exception as e:
        raise DecryptionError(f"{path}: {str(e).splitlines()[0]}") from e
    wanted = columns or df.columns
    hidden = [c for c in wanted if any(m == c or m.startswith(c + ".") for m in missing)]
    if hidden:
        raise DecryptionError(f"{path}: no key for the columns {', '.join(hidden)}")
    return df.select(*(F.col(f"`{c}`") for c in wanted))


def keyring(keys: Any) -> Keyring:
    return keys if callable(keys) else list(keys)
