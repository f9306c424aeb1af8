"""Parameters of an export, checked and filled in before a plan is built."""

from __future__ import annotations

from dataclasses import dataclass, field

from ..functions.filenames import DEFAULT_TEMPLATE
from ..functions.redaction import OFF, Redaction
from ..operators.schema import FORMATS

PROFILES = ("default", "obsidian", "github", "gitbook", "research-log")
PAGE_SIZES = {"a4": (595, 842), "letter": (612, 792)}


#: Colours of a page and of its text, as red, green and blue from 0 to 1.
THEMES = {"light": ((1, 1, 1), (0.075, 0.122, 0.196)), "dark": ((0.067, 0.094, 0.153), (0.933, 0.949, 0.949)), "simple": ((1, 1, 1), (0, 0, 0))}


@dataclass(frozen=True)
class PdfSettings:
    """Font size 8 to 18 and margins 24 to 96 points; what lies outside, or has an unknown name, becomes the default."""

    font_size: float = 11
    margin: float = 54
    page: str = "a4"
    landscape: bool = False
    contents: bool = False
    theme: str = "light"

    def __post_init__(self):
        if not 8 <= self.font_size <= 18:
            object.__setattr__(self, "font_size", 11)
        if not 24 <= self.margin <= 96:
            object.__setattr__(self, "margin", 54)
        if self.page not in PAGE_SIZES:
            object.__setattr__(self, "page", "a4")
        if self.theme not in THEMES:
            object.__setattr__(self, "theme", "light")

    @property
    def size(self) -> tuple[int, int]:
        """Width and height of a page."""
        w, h = PAGE_SIZES[self.page]
        return (h, w) if self.landscape else (w, h)


@dataclass(frozen=True)
class ExportOptions:
    formats: tuple[str, ...] = ("md",)
    scope: str = "all"
    start: float | None = None
    end: float | None = None
    redaction: Redaction = OFF
    template: str = DEFAULT_TEMPLATE
    profile: str = "default"
    include_metadata: bool = True
    include_completeness: bool = True
    include_advanced: bool = True
    include_reasoning: bool = False
    zip_formats: tuple[str, ...] | None = None
    pdf: PdfSettings = field(default_factory=PdfSettings)

    def __post_init__(self):
        formats = tuple(dict.fromkeys(f for f in self.formats if f in FORMATS)) or ("md",)
        object.__setattr__(self, "formats", formats)
        object.__setattr__(self, "template", self.template.strip() or DEFAULT_TEMPLATE)
        if self.profile not in PROFILES:
            object.__setattr__(self, "profile", "default")

    def bundle(self) -> tuple[str, ...]:
        """Formats inside a zip."""
        chosen = self.zip_formats if self.zip_formats is not None else tuple(f for f in self.formats if f != "zip")
        return chosen or ("md", "json", "html")
