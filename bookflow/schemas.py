"""Schemas (as DDL) and allowed values of the engine's tables."""

from __future__ import annotations

NOVEL = "id long, title string, source_url string, source_site string, author string, cover_url string, description string, status string, created_at timestamp_ntz, updated_at timestamp_ntz"
CHAPTER = "id long, novel_id long, idx int, title string, source_url string, raw_text string, translated_text string, status string, updated_at timestamp_ntz"
GLOSSARY_RULE = "id long, source_term string, target_term string, notes string, is_global boolean"
JOB = "id long, novel_id long, job_type string, status string, progress int, total_items int, done_items int, error_message string, created_at timestamp_ntz, updated_at timestamp_ntz"
SITE = "priority int, site_id string, base_url string, is_native_arabic boolean, selectors map<string,string>, request_delay_min double, request_delay_max double, use_curl_cffi boolean, respect_robots_txt boolean"
EVENT = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
PAGE = "page_id long, url string, status int, html string, rendered boolean"
CHAPTER_REF = "page_seq int, pos int, title string, source_url string"

NOVEL_STATUS = ("pending", "scraping", "scraped", "failed")
CHAPTER_STATUS = ("pending", "scraped", "translating", "translated", "failed")
JOB_TYPES = ("scrape", "translate", "build_epub")
JOB_STATUS = ("queued", "running", "paused", "completed", "failed", "cancelled")
#: Chapters that wait for a translation, and those that wait for their text.
TO_TRANSLATE = ("scraped", "translating", "failed")
TO_SCRAPE = ("pending", "failed")
ACTIVE_JOBS = ("queued", "running")
