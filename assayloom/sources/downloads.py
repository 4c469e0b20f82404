"""Open-access downloads: candidate links of an article, payload checks, and one download run over many articles.

The network is a plug-in: ``fetch(url) -> (bytes, content type)``, run on executors. All else is columns and plain helpers.
"""

from __future__ import annotations

import io
import tarfile
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from urllib.parse import quote, urlencode, urlparse

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayloom.functions.exprs import text
from assayloom.operators.lineage import safe_filename
from assayloom.sources.readers import is_pdf, link_urls, open_access_urls

Fetch = Callable[[str], tuple[bytes, str]]
RESULT = "status string, resolver string, url string, payload binary, warnings array<string>, candidates array<string>"
AGENT = "Mozilla/5.0 (compatible; assayloom)"
BROWSER = "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/124.0 Safari/537.36"


def resolver_urls(doi: str) -> dict[str, str]:
    """Where the open indexes describe a DOI, in the order in which their links are tried."""
    ids = urlencode({"ids": doi, "format": "json", "tool": "assayloom"})
    return {"openalex": f"https://api.openalex.org/works/{quote('https://doi.org/' + doi, safe='')}", "ncbi-oa": f"https://www.ncbi.nlm.nih.gov/pmc/utils/idconv/v1.0/?{ids}", "crossref": f"https://api.crossref.org/works/{quote(doi, safe='')}"}


def pmc_id(v: Column) -> Column:
    """The article's PMC identifier in the converter's answer, "" without one."""
    return text(F.try_variant_get(v, "$.records[0].pmcid", "string"))


def https_links(xml: Column) -> Column:
    """The links of an open-access answer in XML, those on the archive's FTP server as HTTPS."""
    return F.transform(F.filter(F.xpath(xml, F.lit("//link/@href")), lambda u: u != ""), lambda u: F.regexp_replace(u, "^ftp://ftp\\.ncbi\\.nlm\\.nih\\.gov/", "https://ftp.ncbi.nlm.nih.gov/"))


def candidates(openalex: Column, ncbi_xml: Column, crossref: Column) -> Column:
    """(resolver, url) of all links of an article, each once, in resolver order."""
    none = F.array().cast("array<string>")
    of = lambda name, urls: F.transform(F.coalesce(urls, none), lambda u: F.struct(F.lit(name).alias("resolver"), u.alias("url")))
    every = F.concat(of("openalex", open_access_urls(openalex)), of("ncbi-oa", https_links(ncbi_xml)), of("crossref", link_urls(crossref)))
    kept = F.filter(every, lambda x, i: ~F.exists(F.slice(every, F.lit(1), i), lambda y: y["url"] == x["url"]))
    return kept


def referer(url: Column) -> Column:
    """The site of a link; "" for what is no link."""
    host, scheme = F.call_function("try_parse_url", url, F.lit("AUTHORITY")), F.call_function("try_parse_url", url, F.lit("PROTOCOL"))
    return F.coalesce(F.concat(scheme, F.lit("://"), host, F.lit("/")), F.lit(""))


def looks_like_archive(payload: Column, kind: Column, url: Column) -> Column:
    return (F.substring(payload, 1, 2) == F.lit(b"\x1f\x8b")) | F.contains(F.lower(kind), F.lit("gzip")) | F.lower(url).endswith(".tar.gz") | F.lower(url).endswith(".tgz")


def pdf_of(payload: bytes, kind: str, url: str) -> bytes | None:
    """The PDF that a payload is or, for an archive, the first of its members that is one."""
    if payload.startswith(b"%PDF-"):
        return payload
    if not (payload.startswith(b"\x1f\x8b") or "gzip" in kind.lower() or url.lower().endswith((".tar.gz", ".tgz"))):
        return None
    with tarfile.open(fileobj=io.BytesIO(payload), mode="r:gz") as archive:
        for member in archive:
            if member.isfile() and member.name.lower().endswith(".pdf") and (f := archive.extractfile(member)) is not None:
                data = f.read()
                if data.startswith(b"%PDF-"):
                    return data
    return None


def http_fetch(timeout: float = 30.0, accept: str = "application/pdf,*/*") -> Fetch:
    """Plain HTTP; a refusal (403) of anything but JSON is tried once more as a browser."""

    def once(url: str, agent: str) -> tuple[bytes, str]:
        parts = urlparse(url)
        site = {"Referer": f"{parts.scheme}://{parts.netloc}/"} if parts.scheme and parts.netloc else {}
        with urllib.request.urlopen(urllib.request.Request(url, headers={"Accept": accept, "User-Agent": agent, **site}), timeout=timeout) as r:
            return r.read(), r.headers.get("Content-Type", "")

    def fetch(url: str) -> tuple[bytes, str]:
        try:
            return once(url, AGENT)
        except urllib.error.HTTPError as e:
            if e.code != 403 or accept == "application/json":
                raise
            return once(url, BROWSER)

    return fetch


def download_one(doi: str, links: list[tuple[str, str]], fetch: Fetch, warnings: list[str] | None = None) -> dict:
    """One article's result: the first link whose payload is, or holds, a PDF."""
    said, urls = list(warnings or []), [u for _, u in links]
    if not doi:
        return {"status": "skipped", "resolver": None, "url": None, "payload": None, "warnings": ["Missing DOI."], "candidates": []}
    for resolver, url in links:
        try:
            payload, kind = fetch(url)
        except Exception as e:  # one link that fails must not end the article
            said.append(f"download failed from {resolver}: {e}")
            continue
        try:
            pdf = pdf_of(payload, kind, url)
        except (tarfile.TarError, EOFError, OSError) as e:
            said.append(f"download failed from {resolver}: {e}")
            continue
        if pdf is None:
            said.append(f"candidate was not a PDF from {resolver}: {url}")
            continue
        return {"status": "downloaded", "resolver": resolver, "url": url, "payload": pdf, "warnings": said, "candidates": urls}
    return {"status": "not-found", "resolver": None, "url": None, "payload": None, "warnings": said or ["No PDF candidates found."], "candidates": urls}


def download(articles: DataFrame, fetch: Fetch, keys: list[str], doi: str = "doi", links: str = "candidates", have: str | None = None, limit: int | None = None, dry_run: bool = False) -> DataFrame:
    """(keys, status, resolver, url, payload, warnings, candidates, file) of articles with their ``links`` (resolver, url).

    ``have``: a column with bytes that are there already; a PDF among them is kept (status exists). ``limit`` takes that
    many articles, ``dry_run`` asks nothing (status dry-run).
    """
    df = articles.limit(limit) if limit is not None else articles
    file = F.concat(safe_filename(F.coalesce(*[F.nullif(text(c), F.lit("")) for c in [*keys, doi]]), "long"), F.lit(".pdf"))
    there = F.coalesce(is_pdf(F.col(have)), F.lit(False)) if have else F.lit(False)
    stale = F.when(F.col(have).isNotNull() & ~there, F.array(F.lit("Existing file is not a valid PDF and will be retried."))) if have else F.lit(None).cast("array<string>")
    df = df.select(*keys, F.coalesce(text(doi), F.lit("")).alias("doi"), F.coalesce(F.col(links), F.array().cast("array<struct<resolver:string,url:string>>")).alias("links"), there.alias("there"), stale.alias("stale"), file.alias("file"))
    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for row in pdf.itertuples(index=False):
                found = [(x["resolver"], x["url"]) for x in row.links]
                if row.there:
                    r = {"status": "exists", "resolver": None, "url": None, "payload": None, "warnings": [], "candidates": []}
                elif dry_run:
                    r = {"status": "dry-run", "resolver": None, "url": None, "payload": None, "warnings": [], "candidates": [u for _, u in found]}
                else:
                    r = download_one(row.doi, found, fetch, None if row.stale is None else list(row.stale))
                out.append({**{k: getattr(row, k) for k in keys}, **r, "file": row.file})
            yield pd.DataFrame(out, columns=[*keys, "status", "resolver", "url", "payload", "warnings", "candidates", "file"])

    return df.mapInPandas(run, f"{kinds}, {RESULT}, file string")
