"""The coder of `rangecoder` as functions of columns, run by the executors' JVMs.

The source lies beside this file. The driver compiles it with the compiler that Spark itself uses for its plans, and Spark
hands the classes to the executors as a jar, so no machine needs a tool or a file of its own.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
import zlib
from importlib.resources import files

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

_UNPACKED = "array<struct<at:int,ids:binary>>"
_FUNCTIONS = {"Pack": "binary", "Unpack": _UNPACKED, "Ids": "array<long>"}
_loaders: dict[str, object] = {}


def _loader(spark: SparkSession):
    """A class loader with the compiled coder, whose classes the executors of this application have, too."""
    app = spark.sparkContext.applicationId
    if app not in _loaders:
        source = (files(__package__) / "RangeCoder.java").read_text(encoding="utf-8")
        compiler = spark._jvm.org.codehaus.janino.SimpleCompiler()
        compiler.setParentClassLoader(spark._jvm.java.lang.Thread.currentThread().getContextClassLoader())
        compiler.cook(source)
        folder = tempfile.mkdtemp()
        atexit.register(shutil.rmtree, folder, True)
        jar = f"{folder}/token-ids-{zlib.crc32(source.encode()):08x}.jar"
        with zipfile.ZipFile(jar, "w") as z:
            for name, code in dict(compiler.getBytecodes()).items():
                z.writestr(name.replace(".", "/") + ".class", bytes(code))
        spark.sparkContext._jsc.sc().addJar(jar)
        _loaders[app] = compiler.getClassLoader()
    return _loaders[app]


def _call(spark: SparkSession, name: str, *columns: Column) -> Column:
    made = _loader(spark).loadClass(f"sievemark.llm.RangeCoder${name}").newInstance()
    kind = spark._jvm.org.apache.spark.sql.types.DataType.fromDDL(_FUNCTIONS[name])
    spark._jsparkSession.udf().register(f"sievemark_token_{name.lower()}", made, kind)
    return F.call_function(f"sievemark_token_{name.lower()}", *columns)


def pack(spark: SparkSession, ids: Column) -> Column:
    """The frame of ids, given as little-endian 32-bit numbers."""
    return _call(spark, "Pack", ids)


def unpack(spark: SparkSession, payload: Column, lengths: Column) -> Column:
    """For each document of a frame, how many ids stand before it and its own as bytes. A damaged frame is an error."""
    return _call(spark, "Unpack", payload, lengths)


def ids(spark: SparkSession, own: Column) -> Column:
    """Bytes of ids as numbers."""
    return _call(spark, "Ids", own)
