"""Small source files of our own for the queries over extractors: the driver's tables hold no such files."""

SQL = """#include <base.h>
create proc CloseDeals
  @DealID DSIDENTIFIER,
  @Count DSINT output
as
begin
  select d.DealID, d.Amount as Total, isnull(d.Brief, '') as Brief
    into pClosed
    from tDeal d
   inner join tClient c on c.ClientID = d.ClientID

  update tDeal set Status = 2, Closed = 1
  exec @r = dbo.LogClosed @DealID
end
X_ANYMODE(CloseDeals)
GO
create table tDeal
(
  DealID DSIDENTIFIER not null,
  Amount DSMONEY,
  Brief  DSBRIEFNAME
)
create unique index XPKtDeal on tDeal(DealID)
"""

CALLED = """create proc LogClosed
  @DealID DSIDENTIFIER
as
begin
  insert into tLog (DealID)
  select @DealID
end
X_ANYMODE(LogClosed)
"""

UNIT = """unit Deals;

interface

uses Classes;

type
  TDeals = class(TObject)
  private
    FCount: Integer;
  public
    procedure Load(const Id: Integer);
  end;

implementation

const
  QUERY = 'select DealID '
        + 'from tDeal where DealID = :ID';

procedure TDeals.Load(const Id: Integer);
begin
  Qr.SQL.Text := QUERY;
  Qr.SQL.Add('order by DealID');
  Qr.Open;
end;

end.
"""
