"""memweft: a Spark-native hybrid-recall engine for document memory."""

from .config import RecallConfig

__version__ = "0.1.0"
__all__ = ["RecallConfig", "Vault", "__version__"]


def __getattr__(name):
    # Vault pulls in pyspark; keep a bare ``import memweft`` light.
    if name == "Vault":
        from .vault import Vault

        return Vault
    raise AttributeError(name)
