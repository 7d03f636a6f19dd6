"""Parameters and row types of the document-overlap engine."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass

SCHEMA_VERSION = 2

BBOX = "struct<x0:double,y0:double,x1:double,y1:double>"
RECT = f"struct<page:int,bbox:{BBOX}>"
LINE = f"struct<start:int,end:int,page:int,bbox:{BBOX}>"
TOKEN = "struct<tok:string,para:int,start:int,end:int>"
RAW_LINE = f"struct<text:string,bbox:{BBOX},sizes:array<struct<size:double,n:int>>,bold_chars:int,chars:int>"

SCHEMAS = {
    "blocks": f"doc_id bigint, page int, block_no int, page_height double, bbox {BBOX}, lines array<{RAW_LINE}>",
    "paragraphs": f"doc_id bigint, id int, kind string, text string, page int, n_tokens int, lines array<{LINE}>, rects array<{RECT}>",
    "sentences": f"doc_id bigint, id int, para int, kind string, text string, page int, span struct<start:int,end:int>, rects array<{RECT}>",
    "figures": f"doc_id bigint, id int, page int, bbox {BBOX}, kind string, sha256 string, width int, height int, caption string, content binary",
}

#: Kinds of text that are compared, in the layers' shared order.
TEXT_KINDS = ("body", "abstract", "caption", "reference")
LEVELS = ("sentence", "paragraph")
FIGURE_VERDICTS = ("exact", "same", "cropped", "similar")


class Params:
    """Shared behaviour of the parameter sets."""

    def to_dict(self) -> dict:
        return asdict(self)

    def digest(self) -> str:
        """Eight hex digits that change with any parameter."""
        return hashlib.sha1(json.dumps(self.to_dict(), sort_keys=True).encode()).hexdigest()[:8]


@dataclass(frozen=True)
class ExtractOptions(Params):
    include_references: bool = False
    ocr: str = "auto"
    ocr_min_chars: int = 200
    figure_dpi: int = 150
    min_figure_pt: float = 40.0
    min_image_px: int = 48
    max_page_fraction: float = 0.9


@dataclass(frozen=True)
class VerbatimParams(Params):
    kgram: int = 6
    window: int = 4
    max_gap: int = 3
    min_run: int = 12
    near_threshold: float = 85
    exact_threshold: float = 100
    min_sentence_tokens: int = 6
    max_fingerprint_positions: int = 50
    include_references: bool = False


@dataclass(frozen=True)
class SemanticParams(Params):
    model: str = "sentence-transformers/all-MiniLM-L6-v2"
    sentence_threshold: float = 0.80
    paragraph_threshold: float = 0.75
    min_sentence_tokens: int = 8
    min_paragraph_tokens: int = 25
    mutual: bool = True
    max_verbatim_fraction: float = 0.5
    include_references: bool = False
    device: str | None = None
    batch_size: int = 64


@dataclass(frozen=True)
class ImageParams(Params):
    phash_threshold: int = 10
    similar_threshold: int = 16
    dhash_threshold: int = 16
    crop_ncc: float = 0.85
    min_std: float = 4.0
    max_side: int = 768


def text_kinds(include_references: bool) -> list[str]:
    return [k for k in TEXT_KINDS if include_references or k != "reference"]
