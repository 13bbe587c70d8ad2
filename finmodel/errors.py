"""Error classes; each has a stable code."""


class ModelError(Exception):
    code = "model_error"


class ParseError(ModelError):
    code = "parse_error"


class TypeRuleError(ModelError):
    code = "type_error"


class CurrencyError(TypeRuleError):
    code = "currency_error"


class ValidationError(ModelError):
    code = "validation_error"


class KernelError(ModelError):
    code = "kernel_error"


class BackendError(ModelError):
    code = "backend_error"


class NumericError(ModelError):
    code = "numeric_error"


class ExecutionError(ModelError):
    code = "execution_error"


class IntentError(ModelError):
    """A request that may not run; ``errors`` has every reason."""

    code = "intent_validation_error"

    def __init__(self, errors: str | list[str]) -> None:
        self.errors = [errors] if isinstance(errors, str) else list(errors)
        super().__init__("; ".join(self.errors))
