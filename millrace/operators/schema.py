"""The tables: messages stay flat, one row each, and are nested only to be rendered."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType, _parse_datatype_string

CODE = "struct<language:string,code:string>"
IMAGE = "struct<alt:string,src:string,dataUri:string,localFilename:string,omittedReason:string,mimeType:string,hash:string,width:int,height:int>"
SOURCE = "struct<id:string,kind:string,title:string,url:string,snippet:string>"
THINKING = "struct<title:string,text:string>"
CANVAS = "struct<title:string,text:string,url:string,warning:string>"

#: Every column of a message but its conversation and position.
MESSAGE = {
    "id": "string",
    "role": "string",
    "author_label": "string",
    "participant": "string",
    "text": "string",
    "markdown": "string",
    "html": "string",
    "code_blocks": f"array<{CODE}>",
    "images": f"array<{IMAGE}>",
    "sources": f"array<{SOURCE}>",
    "thinking_blocks": f"array<{THINKING}>",
    "canvas": f"array<{CANVAS}>",
    "created_at": "string",
    "model": "string",
    "metadata": "map<string,string>",
}
ROLES = ("user", "assistant", "system", "tool", "other")
PLATFORM_NAMES = ("chatgpt", "claude", "gemini", "perplexity", "notebooklm", "unknown")
STATUSES = ("complete", "probably_complete", "partial", "unknown")
FORMATS = ("md", "txt", "json", "csv", "html", "pdf", "docx", "png", "zip")
SOURCE_KINDS = ("citation", "web_search", "deep_research")


def array_of(struct: str) -> ArrayType:
    return ArrayType(_parse_datatype_string(struct))


def struct_of(text: str) -> StructType:
    return _parse_datatype_string(text)


def complete(messages: DataFrame) -> DataFrame:
    """``messages`` with every column of a message; columns it lacks are null. Others pass through."""
    have = set(messages.columns)
    return messages.withColumns({name: F.lit(None).cast(kind) for name, kind in MESSAGE.items() if name not in have})


def from_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``conversations`` table as raw messages (conv_id, idx, role, text)."""
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", F.col("turn").alias("idx"), "role", "text")
