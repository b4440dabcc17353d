"""Settings, read from `docmill.*` keys of the session where they are set there."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Settings:
    max_file_mb: int = 100
    zip_max_total_mb: int = 1024
    zip_max_entries: int = 10_000
    zip_max_ratio: int = 200
    scan_command: str = ""
    scan_timeout_s: int = 60
    verify_mime: bool = False
    default_output_mode: str = "markdown"
    max_rows_per_sheet: int = 10_000
    detect_language: bool = True
    language_sample_chars: int = 2000
    ocr_embedded: bool = False
    ocr_min_pixels: int = 64
    ocr_max_images: int = 20
    max_concurrent_heavy: int = 4
    worker_timeout_s: int = 60
    ocr_min_chars_per_page: int = 100
    ocr_min_chars_per_heavy_page: int = 300
    garbage_ratio: float = 0.3
    heavy_bytes_per_page: int = 500_000
    mbox_max_messages: int = 10_000
    mbox_max_chars: int = 50 * 1024 * 1024
    image_engine: str = "auto"
    gemini_key: str = ""
    pdf_crop_right: float = 30.0
    pdf_crop_top: float = 140.0

    @staticmethod
    def of(spark: SparkSession) -> Settings:
        found = {}
        for f in fields(Settings):
            text = spark.conf.get(f"docmill.{f.name}", None)
            if text is not None:
                kind = type(f.default)
                found[f.name] = text.lower() in ("1", "true", "yes") if kind is bool else kind(text)
        return Settings(**found)

    def ocr_engine(self) -> str:
        """`auto` is the remote engine where a key is set, else the local one."""
        return ("gemini" if self.gemini_key else "tesseract") if self.image_engine == "auto" else self.image_engine


MODES = ("markdown", "structured", "both")


def checked_mode(mode: str | None, settings: Settings | None = None) -> str:
    """A mode in any letter case, or the default one; anything else is refused before a plan is made."""
    found = (mode or (settings or Settings()).default_output_mode).lower()
    if found not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")
    return found
