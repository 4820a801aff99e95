"""Settings of a crawl job: one frozen value that is handed to the builders, never global."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class CrawlConfig:
    max_hops: int = 0
    max_redirect: int = 20
    max_css_jump: int = 10
    max_retry: int = 5
    max_outlinks: int = 0
    max_url_length: int = 4000
    max_segment_repetition: int = 3
    max_segment_threshold: int = 2
    max_content_length_mib: int = 0
    disable_assets: bool = False
    disable_seencheck: bool = False
    capture_alternate_pages: bool = False
    strict_regex: bool = False
    headless: bool = False
    disable_html_tags: tuple[str, ...] = ()
    include_hosts: tuple[str, ...] = ()
    include_strings: tuple[str, ...] = ()
    exclude_hosts: tuple[str, ...] = ()
    exclude_strings: tuple[str, ...] = ()
    exclusions: tuple[str, ...] = ()
    domains_crawl: tuple[str, ...] = ()
    discard_status: tuple[int, ...] = (429,)
    rate_capacity: float = 150.0
    rate_refill: float = 50.0
    dedupe_min_size: int = 1024
    batch: int = 100_000
    max_rounds: int = 1_000

    @property
    def all_excluded_hosts(self) -> tuple[str, ...]:
        """Excluded hosts and the archive's own hosts, which are never crawled."""
        return tuple(dict.fromkeys((*self.exclude_hosts, "archive.org", "archive-it.org")))
