"""Configuration of a crawl: defaults, a YAML file, the environment, an actor's input, validation."""

from __future__ import annotations

import copy
import os
from collections.abc import Mapping
from dataclasses import dataclass

from sitelume.functions import weburl

# The settings of a crawl where nothing else is said.
DEFAULTS = {
    "targets": {
        "startUrls": ["https://example.com"], "allowedDomains": [], "excludedDomains": [], "excludedPaths": [],
        "sitemapDiscovery": True, "respectRobotsTxt": True,
    },
    "crawler": {
        "maxRequestsPerCrawl": 0, "maxConcurrency": 1, "requestTimeoutSecs": 120, "headless": False, "requestDelay": 5000,
        "requestDelayMin": 5000, "requestDelayMax": 30000, "singleUrlMode": False, "incrementalMode": False,
    },
    "extraction": {
        "modules": {
            "basicData": True, "responseData": True, "links": True, "seoTags": True, "specialLinks": True,
            "structuredData": True, "aiMetadata": True, "contentMetrics": True, "pageMap": True, "htmlContent": False, "images": True,
        },
        "links": {"extractAttributes": False, "categorizeByDomain": True},
        "customFields": ["department", "category", "tags", "rating", "difficulty", "audience", "priority", "boost"],
    },
    "output": {
        "files": {"scrapedData": "scraped-data.json", "sitemap": "sitemap.json"},
        "storage": {
            "enabled": True, "path": "./storage",
            "realTimeStorage": {"enabled": True, "saveIndividualFiles": True, "saveJsonl": True, "jsonlFilename": "crawl-data.jsonl"},
        },
        "formatting": {"prettyPrint": True, "includeTimestamp": True},
    },
    "logging": {
        "level": "info", "enableConsole": True, "enableFileLogging": True, "logFile": "crawler.log", "sessionLogs": True,
        "events": {"pageProcessed": True, "errorEncountered": True, "sitemapDiscovered": True, "linksCategorized": False},
    },
    "errorHandling": {"continueOnError": True, "retryCount": 3, "retryDelay": 5000, "skipOnTimeout": True},
    "performance": {"skipHeavyExtraction": False, "batchSize": 5, "clearPageData": True},
}
# What an actor's input leaves out is filled with these instead.
ACTOR_DEFAULTS = {"maxConcurrency": 2, "requestTimeoutSecs": 60, "requestDelay": 1000, "requestDelayMin": 500, "requestDelayMax": 6000}
ACTOR_PATH = "./storage/datasets/default"
# Lists of targets and the environment variables that extend them.
ENV_LISTS = {
    "allowedDomains": "CRAWLER_ALLOWED_DOMAINS", "excludedDomains": "CRAWLER_EXCLUDED_DOMAINS", "excludedPaths": "CRAWLER_EXCLUDED_PATHS",
}
ENV_FLAGS = {"sitemapDiscovery": "CRAWLER_SITEMAP_DISCOVERY", "respectRobotsTxt": "CRAWLER_RESPECT_ROBOTS_TXT"}
ENV_START = "CRAWLER_START_URLS"


@dataclass
class Config:
    targets: dict
    crawler: dict
    extraction: dict
    output: dict
    logging: dict
    errorHandling: dict
    performance: dict

    def base_domain(self) -> str:
        """Host of the first start URL."""
        found = weburl.parse(self.targets["startUrls"][0])
        if found is None:
            raise ValueError(f"{self.targets['startUrls'][0]!r} is not a URL")
        return found.host

    def allowed_domains(self) -> list[str]:
        return self.targets["allowedDomains"] or [self.base_domain()]

    def start_at(self, url: str) -> Config:
        """The same with one start URL, and its host alone (with and without `www.`) allowed."""
        out = copy.deepcopy(self)
        out.targets["startUrls"] = [url]
        if found := weburl.parse(url):
            bare = found.host.removeprefix("www.")
            out.targets["allowedDomains"] = [bare, f"www.{bare}"]
        return out

    def problems(self) -> list[str]:
        """Why the configuration can't be used; empty if it can."""
        out = [] if self.targets["startUrls"] else ["at least one start URL is needed"]
        for url in self.targets["startUrls"]:
            found = weburl.parse(url)
            if found is None or found.scheme not in ("http", "https"):
                out.append(f"{url!r} is not an http(s) URL")
        for name in ("maxConcurrency", "requestTimeoutSecs"):
            if self.crawler[name] < 1:
                out.append(f"{name} must be at least 1")
        return out


def _merge(base: dict, over: Mapping | None) -> dict:
    """`over` laid on `base`, section by section; lists and plain values replace."""
    out = copy.deepcopy(base)
    for key, value in (over or {}).items():
        out[key] = _merge(out[key], value) if isinstance(value, Mapping) and isinstance(out.get(key), dict) else value
    return out


def _parts(text: str) -> list[str]:
    return [x.strip() for x in text.split(",") if x.strip()]


def with_environment(config: Config, env: Mapping[str, str] = os.environ) -> Config:
    """Start URLs and flags of the environment replace, its lists are united with the configured ones."""
    targets = dict(config.targets)
    if env.get(ENV_START):
        targets["startUrls"] = _parts(env[ENV_START])
    for name, variable in ENV_LISTS.items():
        if env.get(variable):
            targets[name] = list(dict.fromkeys([*targets[name], *_parts(env[variable])]))
    for name, variable in ENV_FLAGS.items():
        if variable in env:
            targets[name] = env[variable] == "true"
    return Config(**{**config.__dict__, "targets": targets})


def from_mapping(settings: Mapping | None) -> Config:
    sections = {k: v for k, v in (settings or {}).items() if k in DEFAULTS and isinstance(v, Mapping)}
    return Config(**_merge(DEFAULTS, sections))


def load(path: str | None = None, env: Mapping[str, str] = os.environ) -> Config:
    """The configuration of a YAML file over the defaults, then the environment; the defaults alone if it can't be read."""
    settings = None
    if path and os.path.exists(path):
        import yaml

        with open(path, encoding="utf-8") as f:
            try:
                settings = yaml.safe_load(f)
            except yaml.YAMLError:
                settings = None
    return with_environment(from_mapping(settings if isinstance(settings, Mapping) else None), env)


def from_actor(given: Mapping, env: Mapping[str, str] = os.environ) -> Config:
    """The configuration of an actor's input, which has defaults of its own."""
    if not given.get("startUrls"):
        raise ValueError("startUrls must hold at least one URL")
    told = lambda section, key, default: default if (given.get(section) or {}).get(key) is None else given[section][key]
    plain = lambda key, default: default if given.get(key) is None else given[key]
    number = lambda variable, key: int(env[variable]) if env.get(variable) else plain(key, ACTOR_DEFAULTS[key])
    debug = env.get("DEBUG") in ("true", "1") or bool(given.get("debugMode"))
    config = from_mapping(None)
    config.targets |= {
        "startUrls": [x["url"] for x in given["startUrls"]],
        "sitemapDiscovery": False if env.get("SKIP_SITEMAP_DISCOVERY") == "true" else plain("sitemapDiscovery", True),
        "respectRobotsTxt": plain("respectRobotsTxt", True),
    }
    config.crawler |= {
        "maxRequestsPerCrawl": plain("maxRequestsPerCrawl", 0),
        "maxConcurrency": number("MAX_CONCURRENCY", "maxConcurrency"),
        "requestTimeoutSecs": told("performance", "requestTimeoutSecs", ACTOR_DEFAULTS["requestTimeoutSecs"]),
        "requestDelay": number("REQUEST_DELAY_MS", "requestDelay"),
        "requestDelayMin": plain("requestDelayMin", ACTOR_DEFAULTS["requestDelayMin"]),
        "requestDelayMax": plain("requestDelayMax", ACTOR_DEFAULTS["requestDelayMax"]),
    }
    fixed = {"htmlContent": False, "images": True}
    modules = {name: fixed.get(name, told("extractionModules", name, name != "pageMap")) for name in config.extraction["modules"]}
    config.extraction |= {"modules": modules, "customFields": plain("customFields", config.extraction["customFields"])}
    config.output["storage"]["path"] = ACTOR_PATH
    config.output["formatting"] = {k: told("outputFormats", k, True) for k in ("prettyPrint", "includeTimestamp")}
    config.logging["level"] = "debug" if debug else "info"
    config.logging["events"]["linksCategorized"] = debug
    config.performance["skipHeavyExtraction"] = told("performance", "skipHeavyExtraction", False)
    return config
