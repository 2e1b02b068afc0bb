"""Listening-behaviour analytics on Spark."""

from earshot.api import *  # noqa: F401,F403
from earshot.api import __all__  # noqa: F401
from earshot.session import configure, local_session  # noqa: F401
