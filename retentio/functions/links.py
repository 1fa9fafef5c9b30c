"""Share-link normalisation over a URL column (the download helpers' string logic).

Only the string rewriting is kept: extracting a Drive file id, turning a Dropbox share
host into its direct-download host, taking the file name of a URL, and switching a
OneDrive ``view.aspx`` link to ``download.aspx``. Nothing is downloaded.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------------------
DRIVE_ID_PATTERN = r"/d/([^/]+)"
DROPBOX_SHARE_HOST = "www.dropbox.com"
DROPBOX_DIRECT_HOST = "dl.dropboxusercontent.com"
ONEDRIVE_VIEW = "view.aspx"
ONEDRIVE_DOWNLOAD = "download.aspx"
# ------------------------------------------------------------------------------------------


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def drive_file_id(url) -> Column:
    """Text after ``/d/`` up to the next slash; null when absent."""
    v = F.regexp_extract(_col(url), DRIVE_ID_PATTERN, 1)
    return F.when(v == F.lit(""), F.lit(None).cast("string")).otherwise(v)


def dropbox_direct(url) -> Column:
    return F.replace(_col(url), F.lit(DROPBOX_SHARE_HOST), F.lit(DROPBOX_DIRECT_HOST))


def url_file_name(url) -> Column:
    """Last path segment of the URL with the query string removed ('' for a trailing slash)."""
    no_query = F.element_at(F.split(_col(url), r"\?", 2), 1)
    return F.element_at(F.split(no_query, "/"), -1)


def onedrive_download(url) -> Column:
    return F.replace(_col(url), F.lit(ONEDRIVE_VIEW), F.lit(ONEDRIVE_DOWNLOAD))
