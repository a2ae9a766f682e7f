"""Treatment-effect estimators built on MLlib trees and distributed gradient steps."""
