"""tether: record linkage and deduplication as Spark DataFrame stages."""

__version__ = "0.1.0"


def __getattr__(name: str):
    if name == "Config":
        from tether.config import Config

        return Config
    if name in ("Resolver", "ResolverModel"):
        from tether.plans import resolver

        return getattr(resolver, name)
    raise AttributeError(name)
