"""Imports every plan module so that its queries register."""

from plumbline.plans import cleaning  # noqa: F401
from plumbline.plans import assembly  # noqa: F401
from plumbline.plans import spatial  # noqa: F401
from plumbline.plans import graphs  # noqa: F401
from plumbline.plans import splits  # noqa: F401
from plumbline.plans import certify  # noqa: F401
from plumbline.plans import serving  # noqa: F401
from plumbline.plans import series  # noqa: F401
from plumbline.plans import inferring  # noqa: F401
from plumbline.plans import evidencing  # noqa: F401
from plumbline.plans import auditing, inputs  # noqa: F401
